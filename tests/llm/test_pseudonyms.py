import datetime
import hashlib
import re

from edges import empty_documents, odd_documents
from plumbline.llm import pseudonyms as P


def run(spark, texts, key=P.KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in P.pseudonymise(df, key).collect()}


def feistel(values, radixes, kind, key=P.KEY):
    cut = len(values) // 2
    a, b, ra, rb = values[:cut], values[cut:], radixes[:cut], radixes[cut:]
    for k in range(1, P.ROUNDS + 1):
        other = ",".join(map(str, b))
        noise = [int(hashlib.sha256(f"{key}|{kind}|{k}|{i}|{other}".encode()).hexdigest()[:14], 16) for i in range(len(a))]
        a, b, ra, rb = b, [(v + x) % r for v, x, r in zip(a, noise, ra)], rb, ra
    return a + b


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_against_brute_force(spark):
    out = run(spark, ["4041894974608795", "42.144.35.254", "2024-02-29"])
    digits = [int(c) for c in "4041894974608795"]
    inner = feistel(digits[1:-1], [10] * 14, "card")
    card = [int(c) for c in out[0]["text"]]
    assert card[1:-1] == inner and card[0] == 4 and luhn(card)
    assert out[1]["text"] == ".".join(map(str, feistel([42, 144, 35, 254], [256] * 4, "ip")))
    origin = datetime.date(1800, 1, 1)
    day = (datetime.date(2024, 2, 29) - origin).days
    high, low = feistel([day // P.LOW, day % P.LOW], [P.HIGH, P.LOW], "date")
    assert out[2]["text"] == str(origin + datetime.timedelta(high * P.LOW + low))


def test_links_and_formats(spark):
    out = run(
        spark,
        [
            "pay 4041-8949-7460-8795 or 4041894974608795",
            "call +1 (988) 555-2485 and 988-555-2485, 123-45-6789, +44 20 7946 0958",
            "Mail bosbt.42@mail8.example.com on 02/29/2024, 31.12.1999 and 1999/12/31.",
        ],
    )
    a, b = re.findall(r"[0-9-]{16,}", out[0]["text"])
    assert a.replace("-", "") == b and out[0]["n_card"] == 2 and re.fullmatch(r"(\d{4}-){3}\d{4}", a)
    phones = re.findall(r"\(?[2-9]\d{2}\)?[ -][2-9]\d{2}-\d{4}", out[1]["text"])
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    assert "+1 (" in out[1]["text"] and "988" not in out[1]["text"] and "123-45-6789" not in out[1]["text"]
    assert re.match(r"Mail [a-z]{5}\.\d\d@mail8\.example\.com on \d\d/\d\d/\d{4}, ", out[2]["text"])
    days = re.findall(r"(\d\d)\.(\d\d)\.(\d{4})|(\d{4})/(\d\d)/(\d\d)", out[2]["text"])
    assert days[0][:3][::-1] == days[1][3:]


def test_what_stays(spark):
    texts = ["4041894974608796", "10.0.0.300", "02/30/2024", "000-12-3456", "1.2.3.4.5", "plain 12345", "a@b", "$1 \\1 {0}"]
    out = run(spark, texts)
    assert [out[i]["text"] for i in range(len(texts))] == texts


def test_a_permutation_of_the_format(spark):
    texts = [f"{a}.{b}.7.9" for a in range(20) for b in range(20)] + [f"2024-01-{d:02d}" for d in range(1, 32)]
    out = run(spark, texts)
    assert len({r["text"] for r in out.values()}) == len(texts)
    assert run(spark, texts[:3], "other key")[0]["text"] != out[0]["text"]


def test_edges(spark):
    docs = odd_documents(spark)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in P.pseudonymise(docs).collect()) == sorted(
        (str(r["doc_id"]), str(r["text"])) for r in docs.collect()
    )
    assert P.pseudonymise(empty_documents(spark)).count() == 0


def test_numbers_beside_a_value(spark):
    card, phone = "4041894974608795", "+44 20 7946 0958"
    alone = run(spark, [card, "4041-8949-7460-8795", phone, "2024-05-01", "988-555-2485", "123-45-6789"])
    new, dashed, abroad, date, home, ssn = (alone[i]["text"] for i in range(6))
    cases = [
        (f"{card} 12 apples", f"{new} 12 apples"),
        ("4041-8949-7460-8795 123", f"{dashed} 123"),
        ("4041 8949 7460 8795 123", f"{dashed.replace('-', ' ')} 123"),
        (f"7 {card}", f"7 {new}"),
        ("1234 4041 8949 7460 8795", f"1234 {dashed.replace('-', ' ')}"),
        (f"{card} {card}", f"{new} {new}"),
        (f"{phone} 2024-05-01", f"{abroad} {date}"),
        (f"{phone} 123-45-6789", f"{abroad} {ssn}"),
        ("order 123 988-555-2485", f"order 123 {home}"),
        (f"{card} 123-45-6789, 988-555-2485", f"{new} {ssn}, {home}"),
    ]
    out = run(spark, [a for a, _ in cases])
    assert [out[i]["text"] for i in range(len(cases))] == [b for _, b in cases]
    assert out[5]["n_card"] == 2 and out[6]["n_date"] == out[6]["n_abroad"] == 1


def test_marks_in_the_input(spark):
    """Noncharacters that the operator uses itself, around a card's number and alone."""
    texts = ["\ufdd0 4111111111111111 \ufdd0", "\ufdd04111111111111111\ufdd0", "\ufdd1\ufdd2 4111 1111 1111 1111 \ufdd1\ufdd3", "a \ufdd0 b \ufdd1 c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in P.pseudonymise(docs).collect():
        old, new = texts[r["doc_id"]], r["text"]
        digits = lambda t: "".join(c for c in t if c.isdigit())
        assert r["n_card"] == bool(digits(old))
        assert not digits(old) or digits(old) != digits(new)
        assert [c for c in old if not c.isdigit()] == [c for c in new if not c.isdigit()]
