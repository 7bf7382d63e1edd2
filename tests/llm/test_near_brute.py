"""op4 against all pairs that share a shingle, found plainly."""

import re
from collections import Counter, defaultdict

from curul.llm import near_dedup

LOWER = {code: code + 32 for code in range(65, 91)}


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_components_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    holders, top = defaultdict(list), {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for d, own in sets.items():
        both = Counter(e for s in own for e in holders[s])
        for e, n in both.items():
            if 100 * n >= 85 * (len(own) + len(sets[e]) - n):
                a, b = root(d), root(e)
                top[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(d)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.op4_minhash_near_dedup(spark, small).collect()}
    assert got == {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def test_the_bitmap_loses_no_row(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    ids = spark.range(0, 3000, 7).union(spark.createDataFrame([(-5,)], "id long"))
    for bits in (6, 12, 24):  # one word only, more ids than places, few ids
        kept = {r.doc_id for r in near_dedup.holding(docs, ids, bits).collect()}
        assert kept == set(range(0, 3000, 7))
    assert near_dedup.holding(docs, ids.limit(0)).count() == 0
