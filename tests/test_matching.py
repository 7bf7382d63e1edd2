"""The set-similarity join of titles against all pairs."""

import random

import pytest

from curul.operators import matching

FIELDS = "{} string, title string, alias string, day string, chamber string, authors array<string>, norms array<string>"


def grams(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return {p[i : i + 3] for p in (f"  {w} " for w in words) for i in range(len(p) - 2)}


def rows(draws, count, name):
    words = ["ley", "agua", "minas", "salud", "reforma", "general", "fiscal", "pesca", "x", "educacion"]
    out = []
    for i in range(count):
        title = " ".join(draws.choices(words, k=draws.choice([1, 2, 5, 9])))
        day = None if i % 13 == 0 else f"2020-0{draws.randint(1, 3)}-{draws.randint(10, 28)}"
        out.append((f"{name}{i}", None if i % 17 == 0 else "" if i % 19 == 0 else title, None, day, "senado", [f"a{i % 3}"], []))
    return out


@pytest.mark.parametrize("least", [0.4, 0.7, 1.0])
def test_near_candidates_equal_all_pairs(spark, least):
    draws = random.Random(6)
    left, right = rows(draws, 60, "r"), rows(draws, 150, "i")
    frame = lambda data, key: spark.createDataFrame(data, FIELDS.format(key)).selectExpr("*", "cast(day as date) presented_at").drop("day")
    got = {(r.record_id, r.id) for r in matching.near_candidates(frame(left, "record_id"), frame(right, "id"), least, 20).collect()}
    from datetime import date

    want = set()
    for a in left:
        for b in right:
            x, y = grams(a[1]), grams(b[1])
            if x and y and a[3] and b[3] and len(x & y) >= least * len(x | y) - 1e-12:
                if abs((date.fromisoformat(a[3]) - date.fromisoformat(b[3])).days) <= 20:
                    want.add((a[0], b[0]))
    assert got == want and want


def test_signals_are_measured(spark):
    data = [("r", "Ley de Aguas", "Ley de Aguas", "2020-01-03", "senado", ["a", "b"], ["n"])]
    one = spark.createDataFrame(data, FIELDS.format("record_id")).selectExpr("*", "cast(day as date) presented_at").drop("day")
    two = spark.createDataFrame([("i", *data[0][1:3], "2020-01-01", "senado", ["b"], ["n"])], FIELDS.format("id")).selectExpr("*", "cast(day as date) presented_at").drop("day")
    (row,) = matching.decide(matching.measured_signals(matching.near_candidates(one, two))).collect()
    assert [row[k] for k in matching.WEIGHTS] == pytest.approx([1, 1, 0.5, 1 / 3, 1, 1]) and row.decision == "review"


def test_equal_titles_are_compared_once(spark):
    """Copies of titles give all their pairs, whose similarities come from one comparison of the texts."""
    side = lambda key, name, n, alias: spark.range(n).selectExpr(f"concat('{name}', id) as {key}", "'Ley de Aguas' as title", f"{alias} as alias", "date'2020-01-01' as presented_at", "'senado' as chamber", "array('a') as authors", "array('n') as norms")
    pairs = matching.near_candidates(side("record_id", "r", 3, "if(id = 1, null, 'Ley de Agua')"), side("id", "i", 40, "cast(null as string)"))
    assert {"title_similarity", "alias_similarity"} <= set(pairs.columns)
    got = matching.measured_signals(pairs).collect()
    again = matching.measured_signals(pairs.drop("title_similarity", "alias_similarity")).collect()
    told = lambda rows: sorted((r.record_id, r.id, r.title_similarity, r.alias_similarity) for r in rows)
    assert len(got) == 120 and told(got) == told(again) and {r.alias_similarity > 0 for r in got} == {True, False}
