from compare import connect, differences

from plumbline.llm import chat, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, at string, part string"


def brute(rows):
    convs = {}
    for c, t, r, x in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or "")):
        convs.setdefault(c, []).append((r or "unknown", x or ""))
    kept = {}
    for c, turns in convs.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values()):
            continue
        if any(o == turns and k < c for k, o in convs.items()):
            continue
        kept[c] = "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in turns)
    return kept


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)


def run(spark, rows):
    out = {}
    for r in sorted(chat.render(frame(spark, rows)).collect(), key=lambda r: (r["conv_id"], r["part"])):
        out[r["conv_id"]] = out.get(r["conv_id"], "") + r["text"]
    return out


def test_snapshots(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes"), (None, None)]
    rows = []
    for c, n in enumerate((1, 2, 5, 3, 5)):
        rows += [(c, t, *talk[t]) for t in range(n)]
    rows += [(9, 0, "user", "hi"), (9, 1, "assistant", "other"), (None, 0, "user", "lost"), (10, None, "user", ""), (9, 0, "user", "hi")]
    rows += [(11, 3, "user", "tie b"), (11, 3, "user", "tie a"), (11, 2**40, "tool", "ab" * 20000)]
    assert run(spark, rows) == brute(rows)


def test_one_long_conversation(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(1500)] + [(6, t, "user", f"t{t % 7}") for t in range(1400)]
    rows += [(c, 0, "user", "t0") for c in range(20, 60)]
    assert run(spark, rows) == brute(rows)
    parts = chat.render(frame(spark, rows)).collect()
    assert max(r["n_turns"] for r in parts) <= chat.PART_TURNS and len(parts) == 6


def test_empty(spark):
    assert chat.render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    found = queries.QUERIES["op9_chat_snapshot_collapse"](spark, SF)
    assert differences(found, connect(SF), chat.RENDER_SQL) == []
