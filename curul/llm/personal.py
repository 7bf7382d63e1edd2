"""Personal data: high-recall candidates judged by gradient-boosted trees, with thresholds set on held-out candidates.

Fixed patterns give the base spans, which always stay. Generators propose many more, overlapping ones: spelled-out
and spaced addresses, numbers in other groupings and with other separators. Each is brought to a plain form, from which
its format features are taken, so that a variant looks to the trees like the plain writing that it stands for; features of
the context are added. Candidates whose plain writing proves or refutes their kind are the labelled ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curul.llm.common import Scratch, query, table, texts

# Fixed: the contract's kinds in their order, and its patterns.
KINDS = ("email", "ip", "card", "phone")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, OCTET = (12, 19), (9, 15), 255
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: What stands for an at sign or a dot where an address is spelled out.
AT = re.compile(r"@|＠|[\[({<]\s?(?:at|@)\s?[\])}>]|(?<=\w)\s+at\s+(?=\w)", re.IGNORECASE)
DOT = r"(?:\s?(?:\.|．|[\[({<]\s?(?:dot|\.)\s?[\])}>])\s?|\s+dot\s+)"
BEFORE = re.compile(r"[\w.%+-]+(?:" + DOT + r"[\w%+-]+)*\s?\Z", re.IGNORECASE)
AFTER = re.compile(r"\s?[\w-]+(?:" + DOT + r"[\w-]+)*", re.IGNORECASE)
#: An address's local part has 64 characters at most and its host 255, by the standards of mail.
MOST_LOCAL, MOST_HOST = 64, 255
#: Digits with up to two separators between any two.
DIGITS = re.compile(r"[+(＋]{0,2}\d(?:[\s().\-/‐-―−·:]{0,2}\d)+")
PIECE = re.compile(r"\S+")
#: Nineteen digits with two separators between any two, and what may stand before them, are no longer.
LONGEST = 64

# Words near a candidate that speak for a kind, or for a mere number.
CUES = {
    "email": ("mail", "e-mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "client", "node", "ping"),
    "card": ("card", "visa", "credit", "debit", "mastercard", "tarjeta", "carte", "karte"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "whatsapp", "telefon", "telefono"),
}
AGAINST = ("version", "release", "order", "invoice", "isbn", "section", "chapter", "build", "page", "ticket", "serial", "sku", "date")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
AROUND = 40

FEATURES = (
    *(f"is_{k}" for k in KINDS), "digits", "groups", "longest_group", "length", "plus", "brackets", "spaces", "dots", "dashes", "checksum", "octets_fit",
    "four_groups", "phone_digits", "card_digits", "host_dots", "top_letters", "local_length", "digit_share", "before_digit", "before_letter", "before_mark",
    "after_digit", "after_letter", "after_mark", "token_share", "cue", "other_cue", "against", "letters_around", "digits_around",
)
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
FOUND = "doc_id long, row long, base array<struct<kind:string,start:long,stop:long>>, more array<struct<kind:string,start:long,stop:long,plain:string,proof:int,features:array<double>>>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
MORE_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("plain", pa.string()), ("proof", pa.int32()), ("features", pa.list_(pa.float64()))])
)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The checksum of card numbers: every second digit from the right doubled, digits added up."""
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(int(c) // 5 + int(c) * 2 % 10 for c in digits[-2::-2])) % 10 == 0


def octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= OCTET


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """The contract's spans, leftmost and not overlapping within a kind, by start and then kind."""
    out: list[Span] = []
    free = at = 0
    # An address is found from its at sign: what may stand before one holds none, so this is the leftmost match.
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in LETTERS:
            start -= 1
        host = HOST.match(text, at) if start < at else None
        free = at = host.end() if host else at + 1
        if host:
            out.append(("email", start, host.end()))
    for m in IP.finditer(text):
        if all(octet(p) for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = only_digits(m.group()) if m.end() - m.start() < 2 * CARD_DIGITS[1] else ""
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(only_digits(m.group())) <= PHONE_DIGITS[1]:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def plain(kind: str, text: str) -> str:
    """What a candidate stands for, in plain writing."""
    text = unicodedata.normalize("NFKC", text).strip()
    if kind == "email":
        text = re.sub(DOT, ".", AT.sub("@", text, count=1), flags=re.IGNORECASE)
        return re.sub(r"\s*@\s*", "@", text)
    text = re.sub(r"[‐-―−]", "-", re.sub(r"\s+", " ", text))
    if kind == "ip":
        return re.sub(r"[^0-9]+", ".", text)
    if kind == "card":
        return re.sub(r"[^0-9]+", " ", text).strip()
    return re.sub(r"^(?:\(\+|00|\+\()(?=[1-9])", "+", text)


def proposed(text: str) -> Iterator[Span]:
    """Candidates of all kinds; they overlap each other and the base spans."""
    for m in AT.finditer(text):
        left = BEFORE.search(text, max(0, m.start() - MOST_LOCAL), m.start())
        right = AFTER.match(text, m.end(), m.end() + MOST_HOST)
        if left and right:
            yield "email", left.start(), right.end()
    for m in DIGITS.finditer(text):
        whole = m.group()
        places = {(m.start() + p.start(), m.start() + p.end()) for p in PIECE.finditer(whole)}
        if len(whole) <= LONGEST:
            places.add((m.start(), m.end()))
        for start, end in sorted(places):
            part = text[start:end]
            digits = sum(c.isdigit() for c in part)
            groups = re.findall(r"\d+", part)
            if len(groups) == 4 and max(map(len, groups)) <= 3:
                yield "ip", start, end
            if CARD_DIGITS[0] <= digits <= CARD_DIGITS[1]:
                yield "card", start, end
            if 7 <= digits <= PHONE_DIGITS[1] + 1:
                yield "phone", start, end


def proof(kind: str, written: str, exact: bool) -> int | None:
    """1 for a base span, 0 for plain writing that breaks a rule of its kind, else null: a variant, on which only the model can say."""
    if exact:
        return 1
    if kind == "email":
        return 0 if re.fullmatch(r"[\w.%+-]+@[\w-]+", written) else None
    if kind == "ip":
        return 0 if re.fullmatch(r"[0-9.]+", written) and not all(octet(p) for p in written.split(".")) else None
    digits = only_digits(written)
    if kind == "card":
        return None if luhn(digits) else 0
    return 0 if len(digits) < PHONE_DIGITS[0] - 1 or len(digits) > PHONE_DIGITS[1] or re.fullmatch(r"[0-9]+|[0-9]{1,4}([./-])[0-9]{1,2}\1[0-9]{1,4}", written) else None


def described(text: str, kind: str, start: int, end: int) -> tuple[str, list[float]]:
    """A candidate's plain writing and its features, in the order of FEATURES."""
    written = plain(kind, text[start:end])
    digits, groups = only_digits(written), re.findall(r"[0-9]+", written)
    local, _, host = written.partition("@") if kind == "email" else ("", "", "")
    top = host.rpartition(".")[2] if "." in host else ""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    near = {w.lower() for w in WORD.findall(before)} | {w.lower() for w in WORD.findall(after[: AROUND // 2])}
    left, right = before[-1:], after[:1]
    token = len(re.search(r"\S*\Z", before).group()) + end - start + len(re.match(r"\S*", after).group())
    around = before + after
    values = [
        *(float(kind == k) for k in KINDS), len(digits), len(groups), max(map(len, groups), default=0), len(written), written.startswith("+"),
        sum(written.count(c) for c in "()"), written.count(" "), written.count("."), written.count("-"),
        bool(digits) and len(digits) <= LONGEST and luhn(digits), bool(groups) and all(octet(g) for g in groups), len(groups) == 4,
        PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1], CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1], host.count("."),
        len(top) if top.isalpha() else 0, len(local), len(digits) / max(1, len(written)), left.isdigit(), left.isalpha(), bool(left) and not left.isalnum() and not left.isspace(),
        right.isdigit(), right.isalpha(), bool(right) and not right.isalnum() and not right.isspace(), (end - start) / max(1, token),
        any(w in near for w in CUES[kind]), any(w in near for k in KINDS if k != kind for w in CUES[k]), any(w in near for w in AGAINST),
        sum(c.isalpha() for c in around) / max(1, len(around)), sum(c.isdigit() for c in around) / max(1, len(around)),
    ]
    return written, [float(v) for v in values]


def candidates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a row number of its own, base spans, and every candidate with its plain writing, proof and features."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                base, more = [], []
                for value in part.column(2):
                    text = value.as_py() or ""
                    own = base_spans(text)
                    exact = set(own)
                    out = []
                    for span in sorted(exact.union(proposed(text)), key=lambda s: (s[1], s[2], s[0])):
                        written, features = described(text, *span)
                        out.append(dict(zip(("kind", "start", "stop", "plain", "proof", "features"), (*span, written, proof(span[0], written, span in exact), features), strict=True)))
                    base.append([dict(zip(("kind", "start", "stop"), s, strict=True)) for s in own])
                    more.append(out)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(base, SPAN_ARROW), pa.array(more, MORE_ARROW)], names=["doc_id", "row", "base", "more"])

    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(scan, FOUND)


class Model:
    """Boosted trees and, by kind, the probability from which a candidate counts (none where nothing held out supports one)."""

    def __init__(self, trees: GBTClassificationModel | None, least: dict[str, float]):
        self.trees, self.least = trees, least

    def judged(self, rows: DataFrame) -> DataFrame:
        """``rows`` (features, ...) with ``chance``."""
        with_vector = rows.withColumn("_vector", array_to_vector("features"))
        out = self.trees.transform(with_vector).withColumn("chance", vector_to_array("probability")[1])
        return out.drop("_vector", "rawPrediction", "probability", "prediction")


def labelled(scanned: DataFrame, sample: int | None = None) -> DataFrame:
    """All proved or refuted candidates, one of each writing, or the ``sample`` of the smallest hash; a fifth is held out."""
    c = scanned.select(F.explode("more").alias("c")).select("c.kind", "c.plain", "c.proof", "c.features").where("proof is not null")
    one = c.groupBy("kind", "plain", "proof").agg(F.min_by("features", F.xxhash64("features")).alias("features"))
    name = F.xxhash64("kind", "plain")
    named = one.withColumns({"name": name, "held": F.pmod(name, F.lit(5)) == 0})
    return named.sortWithinPartitions("name", "proof") if sample is None else named.orderBy("name", "proof").limit(sample)


def fit(scanned: DataFrame, scratch: Scratch, sample: int | None = None, precision: float = 0.95, rounds: int = 12, depth: int = 4) -> Model:
    """Trees trained on four fifths of the labelled candidates, thresholds set on the rest.

    ``sample`` may bound the labelled candidates; all others are judged by the result. A kind's threshold is the
    smallest hundredth at which the held-out candidates reach ``precision``, less one standard error, there and above it.
    """
    rows = scratch.table(labelled(scanned, sample).select("kind", F.col("proof").cast("double").alias("label"), "features", "held"))
    if rows.where("not held").agg(F.countDistinct("label")).first()[0] < 2:
        return Model(None, {})
    training = rows.where("not held").select("label", array_to_vector("features").alias("_vector"))
    trees = GBTClassifier(featuresCol="_vector", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=5).fit(training)
    shown = Model(trees, {}).judged(rows.where("held"))
    bins = shown.groupBy("kind", F.floor(F.col("chance") * 100).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("right")).collect()
    least: dict[str, float] = {}
    for kind in KINDS:
        n = right = 0
        for b in sorted((b for b in bins if b["kind"] == kind), key=lambda b: -b["bin"]):
            n, right = n + b["n"], right + b["right"]
            share = right / n
            if share - (share * (1 - share) / n) ** 0.5 < precision or b["bin"] < 50:
                break
            least[kind] = b["bin"] / 100
    return Model(trees, least)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def personal_spans(docs: DataFrame, model: Model | None = None, sample: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``base`` and ``spans`` (kind, start, stop), by start, then kind; added kinds are ``boosted_...``.

    An added span overlaps no base span and no likelier added one. Positions are code points, the end exclusive. Defined
    cases: null and empty texts have no spans; rows that repeat, and rows without doc_id, are scanned each; digits of other
    scripts count in candidates only; without both proved and refuted candidates no model is fitted, and none is added; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    scanned = scratch.table(candidates(docs))
    model = model or fit(scanned, scratch, sample)
    if not model.least:
        result = scratch.kept(scanned.select("doc_id", "base", F.col("base").alias("spans")))
        scratch.drop()
        return result
    # What no base span overlaps is judged; candidates that are, or touch, base spans need no judgement.
    open_ones = F.filter("more", lambda c: ~F.exists("base", lambda b: overlap(b, c)))
    judged = model.judged(scanned.select("row", F.explode(open_ones).alias("c")).select("row", "c.kind", "c.start", "c.stop", "c.features"))
    least = F.create_map(*(F.lit(v) for pair in model.least.items() for v in pair))
    chosen = judged.where(F.col("chance") >= F.try_element_at(least, F.col("kind"))).select("row", F.struct((-F.col("chance")).alias("rank"), "start", "stop", "kind").alias("c"))
    # At most the candidates of one text; the likeliest first, each taken if it touches none taken before.
    taken = chosen.groupBy("row").agg(F.sort_array(F.collect_list("c")).alias("cs")).select("row", F.aggregate(
        "cs", F.slice("cs", 1, 0), lambda kept, c: F.when(F.exists(kept, lambda k: overlap(k, c)), kept).otherwise(F.concat(kept, F.array(c)))
    ).alias("cs"))
    added = F.transform("cs", lambda c: F.struct(F.concat(F.lit("boosted_"), c["kind"]).alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    both = F.concat("base", F.coalesce(added, F.array().cast(SPAN)))
    order = F.array(*(F.lit(k) for k in (*KINDS, *(f"boosted_{k}" for k in KINDS))))
    placed = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    spans = F.transform(placed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    result = scratch.kept(scanned.select("doc_id", "row", "base").join(taken, "row", "left").select("doc_id", "base", spans.alias("spans")))
    scratch.drop()
    return result


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first stands for all."""
    joined = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["stop"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["stop"].alias("at"), F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit("["), F.replace(x["kind"], F.lit("boosted_"), F.lit("")), F.lit("]")).alias("out"))
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(joined)


@query()
def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    rows = personal_spans(texts(table(spark, folder, "documents")))
    shown = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.stop)))"
    return rows.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.expr(shown.format("base")), 256).alias("base_sha256"),
        F.expr(shown.format("spans")).alias("spans"),
    )
