import random

from edges import empty_documents, odd_documents
from plumbline.llm import templates as T

ITEMS = [
    (1, "Alice has 12 apples and gives 5 of them to Bob. How many kg of apples does the other child carry home?"),
    (2, "The quick brown fox jumps over the lazy dog while seven wizards quietly watch from behind an old wall."),
    (3, "Two plus two"),
    (4, None),
    (5, ""),
]


def found(spark, docs, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in T.matches(d, i).collect()}


def test_kinds(spark):
    one = ITEMS[0][1]
    changed = one.replace("12", "31").replace("5", "9").replace("Bob", "Eve").replace("Alice", "Zoe")
    mixed = (
        "Alice has 12 apples and gives 5 of them to Bob. How many kg of apples does the other child carry home? "
        "Alice has 13 apples and gives 6 of them to Bob. How many kg of apples does the other child carry home?"
    )
    out = found(
        spark,
        [
            (10, f"before it {one} and after it"),
            (11, changed),
            (12, "An unrelated text about apples and the other child."),
            (13, ITEMS[1][1].lower()),
            (14, mixed),
            (15, "say two plus two here"),
        ],
    )
    assert out[10, 1]["kind"] == "exact" and out[10, 1]["leaked"] and out[10, 1]["similarity"] == 1
    assert out[11, 1]["kind"] == "changed" and out[11, 1]["leaked"] and out[11, 1]["n_conflicts"] == 0
    assert not any(k[0] == 12 and r["leaked"] for k, r in out.items())
    assert out[13, 2]["leaked"] and out[14, 1]["n_conflicts"] > 0
    assert (15, 3) not in out or out[15, 3]["leaked"]


def test_inconsistent_slots(spark):
    item = [(1, "If 4 red boxes and 4 blue boxes hold 4 green balls then how many balls does one box hold at last")]
    good = "If 8 red boxes and 8 blue boxes hold 8 green balls then how many balls does one box hold at last"
    bad = "If 8 red boxes and 9 blue boxes hold 7 green balls then how many balls does one box hold at last"
    out = found(spark, [(1, good), (2, bad)], item)
    assert out[1, 1]["leaked"] and not out[2, 1]["leaked"]


def test_brute_force_on_words(spark):
    words = "ab cd ef gh ij kl mn op".split()
    texts = [" ".join(words[(i * k) % 8] for i in range(30)) for k in range(1, 8)]
    items = [(k, t) for k, t in enumerate(texts[:3])]
    docs = [(k, t) for k, t in enumerate(texts)]
    cut = lambda t: [tuple(t.split()[i : i + 5]) for i in range(26)]
    out = found(spark, docs, items)
    for d, a in docs:
        for i, b in items:
            x, y = cut(a), cut(b)
            best = max(sum(1 for p in range(26) if 0 <= p + s < 26 and x[p + s] == y[p]) for s in range(-25, 26))
            assert (out[d, i]["n_aligned"] if (d, i) in out else 0) == best


def test_edges(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd_documents(spark)
    assert T.matches(docs, items).count() == 0
    assert T.decontaminate(docs, items).count() == docs.count()
    assert T.matches(empty_documents(spark), items).count() == 0
    assert T.matches(docs, items.limit(0)).count() == 0
    named = docs.withColumnRenamed("text", "t").selectExpr("doc_id", "t AS text", "'x' AS item_id", "1 AS size")
    assert T.decontaminate(named, items).columns == named.columns


def test_one_alignment_is_enough(spark):
    one = ITEMS[0][1]
    other = one.replace("12", "13").replace("5 of", "6 of")
    out = found(spark, [(1, f"{one} {other}"), (2, f"{other} Then {one}")])
    assert out[1, 1]["leaked"] and out[1, 1]["kind"] == "exact" and out[1, 1]["n_conflicts"] > 0
    assert out[2, 1]["leaked"]


def test_values_of_several_words(spark):
    plain = "the quick brown fox jumps over a lazy dog while seven old wizards watch quietly from behind that tall wall near our house today".split()
    item = "On the farm Bob sold 30 large eggs to each of his friends and kept the rest in one big wooden box for later"
    assert len(plain) == 24
    docs = [
        (1, " ".join([*plain[:12], "really", *plain[12:]])),
        (2, item.replace("Bob", "Mary Ann")),
        (3, item.replace("30", "twenty five")),
    ]
    out = found(spark, docs, [(1, " ".join(plain)), (2, item)])
    assert out[1, 1]["leaked"] and out[2, 2]["leaked"] and out[3, 2]["leaked"]
    assert out[2, 2]["kind"] == out[3, 2]["kind"] == "changed"


def test_items_rich_in_slots(spark):
    items = [(1, "Two plus two"), (2, "Add 12 to 30"), (3, "12")]
    out = found(spark, [(1, "say two plus two here"), (2, "please add 12 to 30 now"), (3, "add 13 to 31"), (4, "12 men")], items)
    assert {k for k, r in out.items() if r["leaked"]} == {(1, 1), (2, 2)}


def test_rows_without_an_id_are_documents_of_their_own(spark):
    item = "Alice bought 12 red apples for 5 dollars and gave 3 of them to Bob before lunch on a sunny market day"
    words = item.split()
    halves = [(None, " ".join(words[:11])), (None, " ".join(words[11:])), (None, item)]
    docs = spark.createDataFrame(halves, "doc_id long, text string").repartition(3)
    out = T.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert len(out) == 3 and [r["leaked"] for r in sorted(out, key=lambda r: r["n_aligned"])][-1]
    assert sum(r["kind"] == "exact" for r in out) == 1


def test_recall_of_changed_questions_and_false_hits(spark):
    """Questions with all numbers, names and units changed are found; others of another wording are not."""
    rng = random.Random(5)
    names = ["Alice", "Bob", "Clara", "David", "Emma", "Frank", "Grace", "Henry"]
    units = ["km", "miles", "hours", "dollars", "kg", "litres", "days", "metres"]
    nouns = "farmer teacher river market garden engine village letter window bottle ticket basket wagon bridge school".split()
    verbs = "carries counts sells paints repairs measures collects divides stores delivers".split()

    def frame():
        a, b, c, d = rng.sample(nouns, 4)
        v, w, x = rng.sample(verbs, 3)
        return (
            f"{{n}} {v} {{k}} {{u}} from the {a} near the old {b} every week and then {{m}} {w} exactly {{j}} {{u}} more "
            f"behind the {c} so how many does the {d} hold when somebody {x} what was left"
        )

    def filled(f):
        n, m = rng.sample(names, 2)
        return f.format(n=n, m=m, k=rng.randrange(2, 900), j=rng.randrange(2, 900), u=rng.choice(units))

    def opening():
        a, b, c, d = rng.sample(nouns, 4)
        v, w = rng.sample(verbs, 2)
        return f"{{n}} {v} {{k}} {{u}} from the {a} near the old {b} every week but nobody at this {c} {w} {{j}} {{u}} of {{m}} or any {d} today"

    frames = [frame() for _ in range(150)]
    items = [(i, filled(f)) for i, f in enumerate(frames[:100])]
    changed = [(i, "Some words before. " + filled(f) + "? And words behind it.") for i, f in enumerate(frames[:100])]
    others = [(1000 + i, filled(f)) for i, f in enumerate(frames[100:])]
    others += [(2000 + i, filled(opening())) for i in range(50)]
    out = found(spark, changed + others, items)
    leaked = {k for k, r in out.items() if r["leaked"]}
    assert len({(i, i) for i in range(100)} & leaked) >= 98
    # The same sentence with seven other content words is near enough for some; one that shares its opening never is.
    alike = {d for d, _ in leaked if 1000 <= d < 2000}
    assert len(alike) <= 40 and not [d for d, _ in leaked if d >= 2000]


def test_a_passage_needs_thirteen_words_besides_changed_slots(spark):
    tail = " and then somebody counts everything again behind the river so that nobody there forgets what was left over at last"
    item = [(1, "Frank carries 544 days from the school near the old garden every week" + tail)]
    same = "Frank carries 544 days from the school near the old garden every week but nobody asks"
    other = "Frank carries 806 dollars from the school near the old garden every week but nobody asks"
    longer = "Frank carries 806 dollars from the school near the old garden every month and then somebody but nobody asks"
    shorter = "Frank carries 806 dollars from the school near the old garden every month and then but nobody asks"
    out = found(spark, [(1, same), (2, other), (3, longer), (4, shorter)], item)
    assert [out[k, 1]["leaked"] for k in (1, 2, 3, 4)] == [True, False, True, False]
    assert {out[k, 1]["kind"] for k in (1, 2, 3, 4)} == {"partial"}
