import hashlib
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import repair

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"(s?(ua)+)?\Z")
BLANK = re.compile(r"[^\x20\x09-\x0D]")
LONG = {"u": "user", "a": "assistant"}


def damage(rows):
    """The rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = BLANK.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def row_edits(role, text, fault):
    yield 3, "D", []
    if fault not in ("blank", "duplicate"):
        more = fault == "truncated"
        yield more, "K", [(role, text)]
        yield 2 + more, "R", [("user", text)]
        yield 2 + more, "R", [("assistant", text)]


def exhaustive(rows, flaws):
    """(cost, audit, messages) by trying all edits with at most two inserts in each gap."""
    gaps = [[(2 * len(g), "I" * len(g), [(LONG[c], "") for c in g]) for g in ("", "u", "a", "ua", "au", "uu", "aa")]] * (len(rows) + 1)
    steps = [gaps[0]]
    for (_, role, text), fault, gap in zip(rows, flaws, gaps[1:], strict=True):
        steps += [list(row_edits(role, text, fault)), gap]
    best = None
    for path in itertools.product(*steps):
        key = sum(p[0] for p in path), "".join(p[1] for p in path)
        if best is None or key < best[:2]:
            made = [m for p in path for m in p[2]]
            if PATTERN.match("".join(role[:1] or "?" for role, _ in made)):
                best = (*key, made)
    return best


def by_strings(rows, flaws):
    """The same by a search over (cost, audit) pairs, for long conversations."""
    nxt = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def inserted(paths):
        for c in "ua":
            for came, to in nxt[c].items():
                if came in paths:
                    cost, audit, made = paths[came]
                    new = (cost + 2, audit + "I", (made, (LONG[c], "")))
                    paths[to] = min(paths.get(to, new), new, key=lambda p: p[:2])
        return paths

    paths = inserted({0: (0, "", None)})
    for (_, role, text), fault in zip(rows, flaws, strict=True):
        new = {}
        for came, (cost, audit, made) in paths.items():
            for more, letter, messages in row_edits(role, text, fault):
                to, chain = came, made
                for m in messages:
                    to, chain = nxt.get(m[0][:1], {}).get(came), (made, m)
                if to is not None:
                    way = (cost + more, audit + letter, chain)
                    new[to] = min(new.get(to, way), way, key=lambda p: p[:2])
        paths = inserted(new)
    cost, audit, node = min((paths[p] for p in (0, 3) if p in paths), key=lambda p: p[:2])
    made = []
    while node:
        node, m = node
        made.append(m)
    return cost, audit, made[::-1]


def digest(made):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def expected(conv, rows, solve):
    flaws = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, made = solve(rows, flaws)
    return (
        conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(flaws.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest(made),
    )


def walked(rows, block_rows):
    at, flaws = repair.Paths(block_rows), faults(rows)
    for (_, role, text), fault in zip(rows, flaws, strict=True):
        at.row(role, text.encode(), fault in ("blank", "duplicate"), fault == "truncated")
    return at.result()


def random_rows(n, seed):
    pick = random.Random(seed)
    return [
        (i, pick.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), pick.choice(["a.", "b", "c!", "", f"t{i}.", f"x{i}?"]))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(12))
def test_all_edits_of_short_conversations(seed):
    rows = random_rows(seed % 4, seed)
    cost, audit, made = exhaustive(rows, faults(rows))
    assert by_strings(rows, faults(rows))[:2] == (cost, audit)
    assert walked(rows, 256) == walked(rows, 1) == (cost, audit, digest(made))


@pytest.mark.parametrize("block_rows", [1, 2, 7, 256])
@pytest.mark.parametrize("roles", ["all", "user"])
def test_rebased_integers_decide_alike(block_rows, roles):
    for seed in range(6):
        rows = random_rows(90, seed)
        if roles == "user":
            rows = [(t, "user", f"t{t}.") for t, _, _ in rows]
        cost, audit, made = by_strings(rows, faults(rows))
        assert walked(rows, block_rows) == (cost, audit, digest(made))


def test_long_conversations_stay_fast():
    rows = [(i, "user", f"t{i}.") for i in range(20_000)]
    cost, audit, _ = walked(rows, 256)
    assert cost == 20_000 and len(audit) == 20_000


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute(rows):
    keys = dict.fromkeys(r[0] for r in rows)
    return sorted((expected(k, damage([r for r in rows if r[0] == k]), by_strings) for k in keys), key=str)


def test_damaged_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(k, t, r, x) for k in range(900, 960) for t, r, x in random_rows(9, k)]
    odd = [(None, 0, "user", "A null name."), (None, None, None, None), (7000, None, "user", "x"), (7000, None, "assistant", None),
           (7001, 3, "user", "Twice."), (7001, 3, "user", "Twice."), (7001, 3, "assistant", "Once.\n"), (7001, -4, "system", "é" * 5000 + ".")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "conv_id long, turn long, role string, text string, n_words long, kind string")
    assert result(repair.repair_rows(df.repartition(5))) == brute(rows + odd)


def test_every_row_dropped(spark):
    gone = [(k, 0, "user", "x.") for k in range(2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:3]
    df = spark.createDataFrame(gone, "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert result(repair.repair_rows(df)) == sorted(((k, 0, 0, 0, 0, 0, 0, "", empty) for k, *_ in gone), key=str)
    assert repair.repair_rows(df.limit(0)).count() == 0


def test_one_conversation_holds_most_rows(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"text {t % 50}.") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = [expected(k, [r[1:] for r in rows if r[0] == k], by_strings) for k in (1, 2)]
    assert result(repair.repair(df.repartition(6), block_rows=16)) == sorted(plain, key=str)
