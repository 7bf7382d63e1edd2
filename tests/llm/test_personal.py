"""Personal data: base spans against the contract's patterns, variants found by the model, and defined cases."""

import hashlib
import re

import numpy as np
import pytest

from curul.llm import personal
from curul.llm.common import texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def card(draws):
    body = [int(d) for d in draws.integers(0, 10, 15)]
    total = sum(2 * d - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(body)))
    return "".join(map(str, [*body, -total % 10]))


def test_base_spans_equal_the_patterns():
    draws = np.random.default_rng(8)
    for alphabet in ("a1@.-+ ", "0123456789.", "0189 -+().", "é@@..a_%1"):
        for size in (0, 5, 30, 200):
            for _ in range(150):
                text = "".join(draws.choice(list(alphabet), size))
                assert personal.base_spans(text) == brute(text), text
    numbers = " ".join(f"{card(draws)[:4]} {i} +1 (743) 555-38{i % 90 + 10} {card(draws)} 10.0.{i}.7" for i in range(300))
    assert personal.base_spans(numbers) == brute(numbers)


def test_long_texts_take_no_quadratic_time():
    for unit in ("a", "1", "1.", "@", "a@", "1 ", "+1", "(1", "a at "):
        text = unit * (200_000 // len(unit))
        assert len(personal.base_spans(text)) + sum(1 for _ in personal.proposed(text)) >= 0


@pytest.fixture(scope="module")
def corpus():
    draws = np.random.default_rng(9)
    rows = []
    for i in range(400):
        number = f"{draws.integers(200, 999)}) 555-{draws.integers(1000, 9999)}"
        wrong = str(draws.integers(10**15, 10**16 - 1))
        rows.append((i, f"we met at noon and wrote to name{i}@site{i % 7}.example.com about order {draws.integers(1000, 99999)}, call +1 ({number} or 10.{i % 250}.3.{i % 97}; card {card(draws)} not {wrong}, on 2024-0{i % 9 + 1}-11"))
    return rows


def test_variants_are_found_and_numbers_left_alone(spark, corpus):
    draws = np.random.default_rng(10)
    one, two = card(draws), card(draws)
    wrong = one[:-1] + str((int(one[-1]) + 1) % 10)
    spelled = f"write to jane.roe (at) site3 (dot) example (dot) com, pay with {one} {two} please; order {wrong} of 2024-03-11, version 10.2.3 at noon"
    rows = [*corpus, (1000, spelled), (1001, None), (1002, ""), (1003, spelled), (None, "x")]
    docs = texts(spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, kind string, base int"))
    result = personal.personal_spans(docs)
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in result.collect()}
    cut = [(k, spelled[a:b]) for k, a, b in got[1000]]
    assert ("boosted_email", "jane.roe (at) site3 (dot) example (dot) com") in cut
    assert ("boosted_card", one) in cut and ("boosted_card", two) in cut and not any(wrong in v for _, v in cut)
    assert got[1003] == got[1000] and got[1001] == got[1002] == got[None] == []
    for i, text in rows[:400]:
        assert [s for s in got[i] if not s[0].startswith("boosted")] == brute(text)
    assert sum(len([s for s in got[i] if s[0].startswith("boosted")]) for i in range(400)) <= 4
    shown = {r.doc_id: r.out for r in result.join(docs.dropDuplicates(["doc_id"]), "doc_id").select("doc_id", personal.redacted(docs.text, result.spans).alias("out")).collect()}
    assert shown[1000].startswith("write to [email], pay with [card] [card] please; order " + wrong) and shown[1002] == ""


def test_empty_table_and_texts_without_candidates(spark):
    empty = texts(spark.createDataFrame([], "doc_id long, text string"))
    assert personal.personal_spans(empty).count() == 0
    plain = texts(spark.createDataFrame([(1, "nothing here"), (2, "mail me: a@b.cc")], "doc_id long, text string"))
    assert {r.doc_id: len(r.spans) for r in personal.personal_spans(plain).collect()} == {1: 0, 2: 1}


def test_whole_table_digest(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = personal.op12_pii(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in want) for n in PATTERNS]


def test_every_labelled_candidate_is_learnt_from(spark):
    one = "named_struct('kind', 'ip', 'plain', cast(id as string), 'proof', cast(id % 2 as int), 'features', array(cast(id as double)))"
    scanned = spark.range(20_050).selectExpr(f"array({one}) AS more")
    assert personal.labelled(scanned).count() == 20_050
