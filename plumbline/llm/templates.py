"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question whose
parameters were changed has the template of the original; a run of one type is one
placeholder, so a value may change its number of words. Windows of template
words of the documents are hash-joined with those of the benchmark; along each
alignment the slot values must map consistently (the same value of the item
always meets the same value of the document). Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import bind, written

WINDOW = 5
SIMILARITY = 0.8
#: Words in a row that make a passage of the item even if the item is longer: the same ones, or so many besides slots.
WORDS = 13
PASSAGE = WORDS - WINDOW + 1
#: A window with fewer words that are not slots must agree in its slot values too.
LITERALS = 3
#: Alignments that differ by at most so many words belong to one passage.
NEAR = WINDOW
#: Rows of benchmark windows that may be broadcast (some 40 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000

# Units of measure and money, and number words.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons ounce ounces pound pounds "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks "
    "month months year years percent degrees mph kmh dollar dollars cent cents euro euros"
).split()
NUMBER_WORDS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()

_MARK = "\ue000"
_SEP = "\u0001"


def _tokens(text: Column) -> Column:
    """Letter and digit runs; a name within a sentence carries a mark, decimals are one token."""
    flat = F.regexp_replace(F.translate(text, _MARK, " "), r"[.,](?<=[0-9][.,])(?=[0-9])", "")
    named = F.regexp_replace(flat, r"(\p{Lu}(?<=[\p{L}\p{N},;]\x20\p{Lu})\p{Ll}+)", _MARK + "$1")
    return F.filter(F.split(named, rf"[^\p{{L}}\p{{N}}{_MARK}]+"), lambda x: x != "")


def _slot(token: Column) -> Column:
    """The placeholder of a token, null for a literal word."""
    low = F.lower(token)
    return (
        F.when(token.startswith(_MARK), F.lit("<name>"))
        .when((token >= "0") & (token < ":"), F.lit("<number>"))  # begins with a digit
        .when(low.isin(NUMBER_WORDS + UNITS), F.when(low.isin(UNITS), F.lit("<unit>")).otherwise(F.lit("<number>")))
    )


def _pairs(tokens: Column) -> Column:
    """(template word, slot value) of the tokens, the value null for literal words; a run of one slot type is one."""
    typed = F.transform(tokens, _slot)

    def joined(ss: Column) -> Column:
        n = F.size(ss)
        begins = F.filter(
            F.transform(ss, lambda s, i: F.when(s.isNull() | (i == 0) | ~s.eqNullSafe(F.get(ss, i - 1)), i + 1)),
            lambda i: i.isNotNull(),
        )

        def pair(i: Column, end: Column) -> Column:
            s, t = F.get(ss, i - 1), F.lower(F.get(tokens, i - 1))
            return F.struct(
                F.coalesce(s, t).alias("t"),
                F.when(s.isNotNull(), F.when(end - i == 1, t).otherwise(F.lower(F.array_join(F.slice(tokens, i, end - i), " ")))).alias("v"),
            )

        return bind(begins, lambda bs: F.transform(bs, lambda i, k: pair(i, F.coalesce(F.get(bs, k + 1), n + 1))))

    return bind(typed, joined)


def _windows(size: int) -> Column:
    """(template hash, slot values, rich) of each window of ``size`` words of the column ``_pairs``.

    The hash of a window that is rich in slots is over their values too.
    """
    ps = F.col("_pairs")

    def plain(h: Column, i: Column) -> Column:
        return F.xxhash64(*(F.get(h, i + k) for k in range(-1, size - 1)))

    def window(h: Column, v: Column, i: Column) -> Column:
        slots = F.array_join(F.slice(v, i, size), _SEP)

        def told(x: Column) -> Column:
            literals = size - (F.length(x) - F.length(F.translate(x, _SEP, "")) + 1)
            rich = literals < min(LITERALS, size)
            return F.struct(
                F.when(rich, F.xxhash64(plain(h, i), x)).otherwise(plain(h, i)).alias("hash"), x.alias("slots"),
                rich.alias("rich"), (literals == 0).alias("bare"),
            )

        return bind(slots, told)

    def literal(h: Column, i: Column) -> Column:
        return F.struct(plain(h, i).alias("hash"), F.lit("").alias("slots"), F.lit(False).alias("rich"), F.lit(False).alias("bare"))

    parts = F.struct(
        F.transform(ps, lambda p: F.xxhash64(p["t"])).alias("h"), F.transform(ps, lambda p: p["v"]).alias("v")
    )
    places = F.sequence(F.lit(1), F.size(ps) - (size - 1))

    def at(b: Column, i: Column) -> Column:
        # Most windows have no slot, and then neither values nor their number are looked at.
        none = F.coalesce(*(F.get(b["v"], i + k) for k in range(-1, size - 1))).isNull()
        return F.when(none, literal(b["h"], i)).otherwise(window(b["h"], b["v"], i))

    return F.when(F.size(ps) >= size, bind(parts, lambda b: F.transform(places, lambda i: at(b, i))))


def _exploded(rows: DataFrame, id_name: str, size: int, prefix: str, *more: str) -> DataFrame:
    ids = [id_name, "_row"] if "_row" in rows.columns else [id_name]
    return rows.select(*ids, F.posexplode(_windows(size)).alias(f"{prefix}_at", "w"), *more).select(
        *ids, f"{prefix}_at", F.col("w.hash").alias("hash"), F.col("w.slots").alias(f"{prefix}_slots"),
        F.col("w.rich").alias(f"{prefix}_rich"), F.col("w.bare").alias(f"{prefix}_bare"), *more,
    )


def _forms(items: DataFrame) -> DataFrame:
    """The items' ``_pairs`` as they stand and, ``_inside``, as they look within a sentence.

    A capitalised first word begins a sentence here, but may follow other words in
    a document and look like a name there: its window is there in both forms.
    """
    first = F.get("_tokens", F.lit(0))
    named = F.concat(F.array(F.concat(F.lit(_MARK), first)), F.slice("_tokens", F.lit(2), F.size("_tokens")))
    inside = items.filter(first.rlike(r"^\p{Lu}\p{Ll}+$")).withColumn("_tokens", named).withColumn("_inside", F.lit(True))
    both = items.withColumn("_inside", F.lit(False)).unionByName(inside)
    return both.select("item_id", _pairs(F.col("_tokens")).alias("_pairs"), "_inside")


def _item_windows(forms: DataFrame, size: int) -> DataFrame:
    """Windows of the items that use ``size``: all as long as a window, and one of an item that is shorter."""
    own = forms.filter(F.size("_pairs") >= size if size == WINDOW else F.size("_pairs") == size)
    every = _exploded(own, "item_id", size, "item", "_inside", "_pairs")
    every = every.filter("(not _inside or item_at = 0) and not item_bare")
    words = F.filter(F.slice("_pairs", F.col("item_at") + 1, size), lambda p: p["v"].isNull())
    last = F.get("_pairs", F.col("item_at") + size - 1)["v"].isNull().cast("int")
    return every.withColumns({"item_words": F.size(words), "item_last": last}).drop("_inside", "item_bare", "_pairs")


def _longest_run(places: Column) -> Column:
    """The length of the longest run of consecutive numbers among distinct ones."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"] + 1, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.sort_array(places), start, step, lambda s: s["best"])


def _most_words(windows: Column) -> Column:
    """The most literal words in a run of windows, given their (place, literal words, whether the last word is one)."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        more = F.when(x["at"] == s["last"], s["run"]).when(x["at"] == s["last"] + 1, s["run"] + x["more"])
        run = F.coalesce(more, x["words"])
        return F.struct(x["at"].alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.sort_array(windows), start, step, lambda s: s["best"])


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item whose templates share a window.

    Columns: ``doc_id``, ``item_id``, ``n_windows`` (of the item, without those rich
    in slots unless it has no others), ``n_aligned`` (the most of them that the
    document has along one alignment), ``n_slots``, ``n_changed`` and
    ``n_conflicts`` (slot values of the item in all hits, those that differ, and
    those that meet several values), ``similarity`` (the share of the windows in
    the best passage), ``kind`` (exact, changed or partial) and ``leaked``: one
    alignment, or one passage of neighbouring alignments, has enough of the item's
    windows, or ``WORDS`` words in a row whose slot values are the item's or that are no slots, and
    consistent slot values. Null texts have no windows, repeated rows
    of a ``doc_id`` count together, rows without one each on their own, an empty
    table on either side gives no rows, and extra columns are not read. Texts of any
    length are read whole. An item shorter than a window is one window of
    its own length; an item of slots alone is never found.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    forms = _forms(items.select("item_id", _tokens(text).alias("_tokens")))
    own_row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    docs = docs.select("doc_id", own_row.alias("_row"), _tokens(text).alias("_tokens")).select(
        "doc_id", "_row", _pairs(F.col("_tokens")).alias("_pairs")
    )
    sizes = sorted(r[0] for r in forms.select(F.least(F.size("_pairs"), F.lit(WINDOW))).distinct().collect() if r[0])
    hits = totals = None
    for size in sizes or [WINDOW]:
        wanted = _item_windows(forms, size)
        own = wanted.select("item_id", "item_at", "item_rich")
        totals = own if totals is None else totals.unionByName(own)
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        own = _exploded(docs, "doc_id", size, "doc").drop("doc_rich", "doc_bare").join(wanted, "hash")
        hits = own if hits is None else hits.unionByName(own)
    plain = F.when(~F.col("item_rich"), F.col("item_at"))
    totals = totals.groupBy(F.col("item_id").alias("_of")).agg(
        F.countDistinct("item_at").alias("_every"), F.size(F.collect_set(plain)).alias("_plain")
    )
    hits = written(hits, "template-hits")
    key = ["doc_id", "_row", "item_id"]
    # An alignment is one shift; the shifts of a passage follow one another in steps of NEAR at most.
    shifts = Window.partitionBy(*key).orderBy("_shift")
    step = F.col("_shift") - F.lag("_shift").over(shifts)
    placed = hits.withColumn("_shift", F.col("doc_at") - F.col("item_at")).withColumn("_new", (step > NEAR).cast("int"))
    placed = placed.withColumn("_passage", F.sum(F.coalesce("_new", F.lit(0))).over(shifts))
    inside = Window.partitionBy(*key, "_passage")
    single = F.min("_shift").over(inside) == F.max("_shift").over(inside)
    groups = F.when(F.col("_single"), F.array(F.struct(F.lit(True).alias("one"), F.col("_shift").cast("long").alias("at")))).otherwise(
        F.array(
            F.struct(F.lit(True).alias("one"), F.col("_shift").cast("long").alias("at")),
            F.struct(F.lit(False).alias("one"), F.col("_passage").cast("long").alias("at")),
        )
    )
    values = F.when(
        F.col("item_slots") != "",
        F.arrays_zip(F.split("item_slots", _SEP).alias("a"), F.split("doc_slots", _SEP).alias("b")),
    )
    judged = (
        placed.withColumn("_single", single)
        .select(
            *key, "item_at", "item_rich", values.alias("_values"), F.explode(groups).alias("g"),
            F.when(F.col("item_slots") == F.col("doc_slots"), F.col("item_at")).alias("_same_at"),
            F.struct(F.col("item_at").alias("at"), F.col("item_words").alias("words"), F.col("item_last").alias("more")).alias("_words"),
        )
        .groupBy(*key, "g")
        .agg(
            F.size(F.collect_set("item_at")).alias("n_every"),
            _longest_run(F.collect_set("_same_at")).alias("n_row"),
            _most_words(F.collect_set("_words")).alias("n_words"),
            F.size(F.collect_set(plain)).alias("n_plain"),
            F.array_distinct(F.flatten(F.collect_set("_values"))).alias("_values"),
        )
    )
    names = lambda ps: F.array_distinct(F.transform(ps, lambda p: p["a"]))
    torn = F.filter(names(F.col("_values")), lambda a: F.size(F.filter("_values", lambda p: p["a"] == a)) > 1)
    judged = judged.join(totals, F.col("item_id").eqNullSafe(F.col("_of"))).withColumns(
        {
            "n_own": F.when(F.col("_plain") > 0, F.col("n_plain")).otherwise(F.col("n_every")),
            "n_windows": F.when(F.col("_plain") > 0, F.col("_plain").cast("long")).otherwise(F.col("_every")),
            "whole": ((F.col("_plain") > 0) & (F.col("n_plain") >= SIMILARITY * F.col("_plain")))
            | (F.col("n_every") >= SIMILARITY * F.col("_every")),
            "consistent": F.size(torn) * 5 <= F.size(names(F.col("_values"))),
            "same": F.size(F.filter("_values", lambda p: p["a"] != p["b"])) == 0,
        }
    )
    aligned = judged.groupBy(*key).agg(
        F.first("n_windows").alias("n_windows"),
        F.max(F.when(F.col("g.one"), F.col("n_own").cast("long"))).alias("n_aligned"),
        F.max("n_own").alias("_best"),
        F.bool_or("whole").alias("whole"),
        F.bool_or(F.col("whole") & F.col("same")).alias("same"),
        F.bool_or((F.col("whole") | (F.col("n_row") >= PASSAGE) | (F.col("n_words") >= WORDS)) & F.col("consistent")).alias("leaked"),
    )
    pairs = hits.filter("item_slots <> ''").select(*key, F.explode(values).alias("p"))
    slots = (
        pairs.groupBy(*key, F.col("p.a").alias("a"))
        .agg(F.min("p.b").alias("low"), F.max("p.b").alias("high"))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_doc_row"), F.col("item_id").alias("_item"))
        .agg(
            F.count("*").alias("n_slots"),
            F.count_if((F.col("low") != F.col("a")) | (F.col("high") != F.col("a"))).alias("n_changed"),
            F.count_if(F.col("low") != F.col("high")).alias("n_conflicts"),
        )
    )
    both = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("_row").eqNullSafe(F.col("_doc_row"))
    both = both & F.col("item_id").eqNullSafe(F.col("_item"))
    out = aligned.join(slots, both, "left").fillna(0, ["n_slots", "n_changed", "n_conflicts"])
    return out.select(
        "doc_id", "item_id", "n_windows", "n_aligned", "n_slots", "n_changed", "n_conflicts",
        F.round(F.col("_best") / F.col("n_windows"), 6).alias("similarity"),
        F.when(~F.col("whole"), F.lit("partial")).when(F.col("same"), F.lit("exact")).otherwise(F.lit("changed")).alias("kind"),
        "leaked",
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of an item; rows with a null ``doc_id`` stay."""
    leaked = matches(docs, items).filter("leaked").select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)
