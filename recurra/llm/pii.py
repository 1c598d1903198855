"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

High-recall patterns propose spans, overlapping ones included. Strict patterns
with their checks are always right by contract and stay. The wide proposals are
scored by boosted trees over format and context; the trees learn from all labels
that don't come from the strict patterns alone (see `_evidence`), all proposals that
lie on strict spans, all strict spans rewritten into the wide formats, and a few
examples. A threshold for each kind and format, calibrated on all of them by trees that
did not learn from them, selects every span that is added; evidence is a label and a
feature only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.common import spare, written

# The kinds in order, and the strict patterns (possessive, and anchored where a run of characters
# begins or the last match ended, which leaves their matches the same and makes them linear).
KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: Wide patterns: spelled-out addresses, defanged and long addresses, grouped digits, numbers without a plus.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[{]at[)\]}])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}|(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{1,4}+)(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[\x20./_-]?[0-9]{3,6}){2,5}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])\(?[0-9]{1,4}\)?(?:[\x20./-]{0,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be worth trying; each strict pattern implies its own.
STRICT_NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
NEEDS = {"email": "@|[(\\[{]at[)\\]}]", "ip": "[0-9:]", "card": "[0-9]{3}", "phone": "[0-9]{2}"}
WORDS = {"email": "mail|contact|write", "ip": r"\bip\b|host|addr|server", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobil|fax|sms"}

#: Spelled-out separators, a dot with a space on one side only, and an address of eight groups or with "::".
BRACKETED = r"[(\[{](?:at|dot)[)\]}]|[(\[]\.[)\]]"
ONE_SIDED = r"(?<!\x20)\.\x20|\x20\.(?!\x20)"
_HEX = "[0-9A-Fa-f]{1,4}"
COLONS = f"^(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX})*)?::{_HEX}(?::{_HEX})*)$"

#: Distinct proposals that are fitted: all. A number, for trials only, bounds them.
TRAIN_ROWS: int | None = None
TREES, DEPTH = 12, 4
#: Parts of the proposals; each is scored for the thresholds by trees that learn from the others.
FOLDS = 2
#: Least share of proposals above the threshold that must be positive.
PRECISION = 0.99
#: Distinct proposals, scored by trees that did not learn from them, from which a format has a threshold of its own; one with fewer takes its kind's, or that of all.
LEAST_HELD_OUT = 100
#: No threshold is lower, and it stands where there are no proposals.
LEAST_SCORE = 0.5
#: Kind, text before, span, text after, and label: both classes are known whatever the documents hold.
EXAMPLES = (
    (0, "mail me: ", "ann [at] home [dot] org", " soon", 1.0),
    (0, "write to ", "bob(at)work(dot)net", "", 1.0),
    (0, "contact ", "eve @ shop . com", "", 1.0),
    (0, "we meet ", "there @ noon. Then", " we", 0.0),
    (0, "come ", "early (at) noon. Bring", " it", 0.0),
    (1, "host ", "192[.]168[.]1[.]9", " is down", 1.0),
    (1, "addr ", "2001:db8::1", "", 1.0),
    (1, "version ", "512[.]1[.]0[.]4", "", 0.0),
    (1, "at ", "10:20:30", " sharp", 0.0),
    (1, "mac ", "00:1b:44:11:3a", "", 0.0),
    (2, "card ", "4242.4242.4242.4242", "", 1.0),
    (2, "visa ", "4000/0000/0000/0002", "", 1.0),
    (2, "order ", "4242.4242.4242.4243", "", 0.0),
    (2, "part ", "123456/789012", "", 0.0),
    (3, "call ", "555 010 4477", " now", 1.0),
    (3, "phone: ", "(0555) 010-4477", "", 1.0),
    (3, "on ", "2024-01-31", "", 0.0),
    (3, "numbers ", "1200 3400 5600", "", 0.0),
)
#: Where the trees may cut a feature that is no flag. Cuts are fixed since MLlib would choose them from a sample of rows.
CUTS = {
    "chars": (8, 10, 12, 14, 16, 18, 20, 24, 28, 32, 40, 56), "digits_n": (1, 3, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20), "share": (0.01, 0.2, 0.4, 0.6, 0.75, 0.85, 0.95, 1),
    "spaces": (1, 2, 3, 4, 5), "dashes": (1, 2, 3, 4), "dots": (1, 2, 3, 4, 5), "brackets": (1, 2, 3, 4, 6), "slashes": (1, 2, 3, 4, 5, 6, 7), "letters": (1, 2, 4, 6, 8, 12, 16, 24),
    "groups": (1, 2, 3, 4, 5, 6, 8), "longest": (1, 2, 3, 4, 5, 6, 7, 9, 13), "shortest": (1, 2, 3, 4, 5, 6), "lead": (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
}
BEFORE, AFTER = 24, 8
_MARK, _OTHER = "\x01", "\x02"
_SPAN = "array<struct<kind:int,start:long,end:long>>"


def _segments(text: Column, pattern: str, needs: str) -> Column:
    """The text cut into gaps (even places) and matches (odd places); null where nothing can match."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")
    return F.when(text.rlike(needs), F.split(marked, _MARK, -1))


def _digits(col: str) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, at most 19, pass the Luhn check."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(F.ascii(c) > 52, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid() -> Column:
    n = F.length("digits")
    return (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, F.col("span").rlike(OCTETS))
        .when(F.col("kind") == 2, F.when(n.between(13, 19), _luhn(F.col("digits"))).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All proposed spans with their place in code points, and one row of kind -1 for every document."""
    text = F.col("text")
    sources = [F.struct(F.lit(-1).alias("kind"), F.lit(False).alias("strict"), F.array(F.lit("")).alias("parts"))]
    for i, kind in enumerate(KINDS):
        for strict, patterns, needs in ((True, STRICT, STRICT_NEEDS), (False, WIDE, NEEDS)):
            sources.append(F.struct(F.lit(i).alias("kind"), F.lit(strict).alias("strict"), _segments(text, patterns[kind], needs[kind]).alias("parts")))
    # The row number comes before the explosion: beside it, each exploded row would get a number of its own.
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = docs.select("row", "id", F.xxhash64("text").alias("text_hash"), F.explode(F.array(*sources)).alias("s"))
    rows = rows.where((F.col("s.kind") < 0) | (F.size("s.parts") > 1))
    parts = rows.select("row", "id", "text_hash", "s.kind", "s.strict", F.posexplode("s.parts").alias("at", "part"))
    # Only lengths, matches and the edges of gaps are shuffled, never whole texts.
    odd = F.col("at") % 2 == 1
    slim = parts.select("row", "id", "text_hash", "kind", "strict", "at", F.length("part").alias("n"), F.when(odd, F.col("part")).alias("span"), F.when(~odd, F.right("part", F.lit(BEFORE))).alias("tail"), F.when(~odd, F.left("part", F.lit(AFTER))).alias("head")).repartition("row")
    order = Window.partitionBy("row", "kind", "strict").orderBy("at")
    placed = slim.withColumn("end", F.sum("n").over(order)).withColumn("before", F.lag("tail").over(order)).withColumn("after", F.lead("head").over(order))
    spans = placed.where((F.col("kind") < 0) | odd).select("row", "id", "text_hash", "kind", "strict", (F.col("end") - F.col("n")).alias("start"), "end", "span", "before", "after", _digits("span").alias("digits"))
    spans = spans.withColumn("valid", F.coalesce(F.col("strict") & _valid(), F.lit(False)))
    # A proposal is covered if a strict span of its kind overlaps it; strict spans of a kind don't overlap each other.
    by_start = Window.partitionBy("row", "kind").orderBy("start")
    before = F.max(F.when(F.col("valid"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    # Backwards, so that the frame only grows.
    following = F.min(F.when(F.col("valid"), F.col("start"))).over(Window.partitionBy("row", "kind").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0))
    covered = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    return spans.withColumn("covered", covered)


def _octets() -> Column:
    return F.regexp_replace("span", r"[\[(]\.[\])]", ".").rlike(OCTETS)


def _format() -> Column:
    """0 plain, 1 bracketed, 2 an address with spaces or colons, 3 digits with dots, slashes or underscores."""
    span, kind = F.col("span"), F.col("kind")
    return (
        F.when((kind < 2) & span.rlike(BRACKETED), 1)
        .when((kind == 0) & span.contains(" ") | (kind == 1) & span.contains(":"), 2)
        .when((kind > 1) & span.rlike("[./_]"), 3)
        .otherwise(0)
    )


def _evidence() -> Column:
    """Whether a proposal's normalised form is personal data: true, false, or null where its form can't tell.

    Addresses must read as one when spelled-out and spaced separators are undone, cards pass
    Luhn, and numbers without a plus must have a word for a phone before them.
    """
    span, n = F.col("span"), F.length("digits")
    loose = span.rlike(r"\x20@|@\x20")
    email = (
        F.when(span.rlike(r"[(\[{]dot[)\]}]") | span.rlike(r"[(\[{]at[)\]}]") & ~span.rlike(ONE_SIDED), True)
        .when(~span.rlike(BRACKETED) & ~F.regexp_replace(span, r"\x20([@.])\x20", "$1").contains(" "), True)
        .when(~span.rlike(BRACKETED) & loose & span.rlike(ONE_SIDED), False)
    )
    ip = F.when(span.contains(":"), F.when(~span.rlike(COLONS), False).when(n > 0, True)).otherwise(_octets())
    card = F.when(n.between(13, 19), _luhn(F.col("digits"))).otherwise(False)
    phone = n.between(9, 15) & F.coalesce(F.lower("before").rlike(WORDS["phone"]), F.lit(False))
    return F.when(F.col("kind") == 0, email).when(F.col("kind") == 1, ip).when(F.col("kind") == 2, card).otherwise(phone)


def _rewritten(found: DataFrame) -> DataFrame:
    """Valid strict spans, where they stand, in formats that only the wide patterns propose."""
    address = lambda at, dot: F.regexp_replace(F.regexp_replace("span", r"\.(?=[^@]*$)", dot), "@", at)
    octet = [F.get(F.split("span", r"\."), F.lit(i)).try_cast("int") for i in range(4)]
    bare, national = F.regexp_replace("span", r"^\+", ""), F.regexp_replace("span", r"^\+[0-9]{1,3}[^0-9()]+", "")
    forms = {
        "email": [address(" [at] ", " [dot] "), address("(at)", "(dot)"), address(" @ ", " . "), address(" @", ".")],
        "ip": [*(F.regexp_replace("span", r"\.", dot) for dot in ("[.]", "(.)")), *(F.format_string(f"{zeros}ffff:%02x%02x:%02x%02x", *octet) for zeros in ("::", "0:0:0:0:0:"))],
        "card": [F.regexp_replace("digits", "([0-9]{4})(?=[0-9]{3})", f"$1{sep}") for sep in "./_"],
        "phone": [bare, national, *(F.regexp_replace(x, "[^0-9]+", sep) for x in (bare, national) for sep in "./")],
    }
    parts = [
        found.where((F.col("kind") == i) & F.col("valid")).select("kind", F.explode(F.array(*forms[k])).alias("span"), "before", "after").where(F.col("span").rlike(f"^(?:{WIDE[k]})$") & (F.lit(k != "phone") | (F.length(_digits("span")) >= 9)))
        for i, k in enumerate(KINDS)
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("digits", _digits("span")).withColumn("label", F.lit(1.0))


def _features() -> dict[str, Column]:
    span, n = F.col("span"), F.length("digits")
    count = lambda chars: F.length(span) - F.length(F.translate(span, chars, ""))
    groups = F.split(F.regexp_replace(span, "[^0-9]+", " "), " ")
    out = {f"is_{k}": (F.col("kind") == i).cast("double") for i, k in enumerate(KINDS)}
    out |= {
        "chars": F.length(span), "digits_n": n, "share": n / F.length(span), "spaces": count(" "), "dashes": count("-"), "dots": count("."), "brackets": count("()[]{}"), "slashes": count("/_:"),
        "letters": F.length(F.regexp_replace(span, "[^A-Za-z]", "")), "groups": F.size(F.filter(groups, lambda g: g != "")), "longest": F.array_max(F.transform(groups, F.length)), "shortest": F.array_min(F.transform(F.filter(groups, lambda g: g != ""), F.length)),
        "luhn": F.when(n.between(13, 19), _luhn(F.col("digits"))).otherwise(False), "octets": _octets(), "colons": span.rlike(COLONS), "lead": F.when(n > 0, F.ascii("digits") - 48).otherwise(-1),
        "bracketed": span.rlike(BRACKETED), "one_sided": span.rlike(ONE_SIDED), "loose_at": span.rlike(r"\x20@|@\x20"),
        "starts_low": F.col("digits").startswith("0"), "touches_before": F.col("before").rlike("[A-Za-z0-9]$"), "touches_after": F.col("after").rlike("^[A-Za-z0-9]"),
    }
    evidence = _evidence()
    out |= {"evident": evidence, "refuted": ~evidence}
    out |= {f"near_{k}": F.lower("before").rlike(w) for k, w in WORDS.items()}
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


def _vectors(df: DataFrame) -> DataFrame:
    """The rows with a vector of flags in `features`: each feature, or for one with cuts whether it reaches each."""
    values = df.select("*", F.struct(*(v.alias(k) for k, v in _features().items())).alias("values"))
    flags = {}
    for name in _features():
        value = F.col(f"values.{name}")
        flags |= {f"{name}_{i}": (value >= cut).cast("double") for i, cut in enumerate(CUTS[name])} if name in CUTS else {name: value}
    ready = values.select("*", *(v.alias(k, metadata={"ml_attr": {"type": "binary"}}) for k, v in flags.items()))
    return VectorAssembler(inputCols=list(flags), outputCol="features").transform(ready).drop(*flags, "values")


@dataclass(frozen=True)
class Trees:
    model: object
    #: By kind and format, by kind alone (format -1), and for all (-1, -1); above 1 where none is precise enough.
    thresholds: dict[tuple[int, int], float]

    def limit(self) -> Column:
        """The threshold of each row: its format's, else its kind's, else that of all."""
        out = F.lit(self.thresholds[-1, -1])
        for (kind, form), value in sorted(self.thresholds.items()):
            if kind >= 0:
                out = F.when((F.col("kind") == kind) & (F.lit(form < 0) | (_format() == form)), value).otherwise(out)
        return out

    def probability(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(_vectors(df))
        return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _thresholds(bins: list) -> dict[tuple[int, int], float]:
    """The lowest score above which PRECISION of the proposals are positive, for formats, kinds and all.

    `bins` are rows (kind, format, bin, hits, n, distinct). Formats and kinds with few distinct proposals are left out.
    """
    sums: dict[tuple[int, int], dict[int, list[float]]] = {(-1, -1): {}}
    for r in bins:
        for key in ((r["kind"], r["format"]), (r["kind"], -1), (-1, -1)):
            cell = sums.setdefault(key, {}).setdefault(r["bin"], [0.0, 0.0, 0.0])
            cell[:] = [cell[0] + r["hits"], cell[1] + r["n"], cell[2] + r["distinct"]]
    out = {}
    for key, cells in sums.items():
        if key[0] >= 0 and sum(c[2] for c in cells.values()) < LEAST_HELD_OUT:
            continue
        best, hits, n = 2.0 if cells else LEAST_SCORE, 0.0, 0.0
        for at in sorted(cells, reverse=True):
            hits, n = hits + cells[at][0], n + cells[at][1]
            if hits >= PRECISION * n:
                best = max(at / 100, LEAST_SCORE)
        out[key] = best
    return out


def _trained(known: DataFrame) -> Trees:
    """Boosted trees that learn from all rows and the examples; no thresholds yet."""
    examples = known.sparkSession.createDataFrame(EXAMPLES, "kind int, before string, span string, after string, label double").coalesce(1).withColumn("digits", _digits("span"))
    taught = known.select("kind", "span", "before", "after", "digits", "label").unionByName(examples)
    return Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=4, labelCol="label").fit(_vectors(taught).select("label", "features")), {})


def fit(found: DataFrame) -> Trees:
    """Boosted trees and thresholds from all distinct proposals and the examples.

    The trees learn from every proposal. The thresholds count every one, too, scored by
    trees that learn from the other parts only.
    """
    wide = found.where((F.col("kind") >= 0) & ~F.col("strict"))
    natural = wide.withColumn("label", F.when(F.col("covered"), F.lit(True)).otherwise(_evidence()).cast("double")).where(F.col("label").isNotNull())
    known = natural.select("kind", "span", "before", "after", "digits", "label").unionByName(_rewritten(found))
    # Copies teach as one, and count for the thresholds as often as they stand in the texts.
    sample = known.groupBy("kind", "span", "before", "after", "digits").agg(F.max("label").alias("label"), F.count("*").alias("weight"))
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("span", "before", "after"), F.lit(FOLDS)))
    if TRAIN_ROWS is not None:
        sample = sample.orderBy(F.xxhash64("span", "before", "after", "kind")).limit(TRAIN_ROWS)
    sample = written(sample, "sample")
    scored = [_trained(sample.where(F.col("fold") != i)).probability(sample.where(F.col("fold") == i)) for i in range(FOLDS)]
    bins = reduce(DataFrame.unionByName, scored).groupBy("kind", _format().alias("format"), F.floor(F.col("score") * 100).alias("bin")).agg(F.sum(F.col("label") * F.col("weight")).alias("hits"), F.sum("weight").alias("n"), F.count("*").alias("distinct"))
    return Trees(_trained(sample).model, _thresholds([r.asDict() for r in bins.collect()]))


def _accepted(found: DataFrame) -> DataFrame:
    """The wide proposals outside strict spans of their kind whose score reaches their threshold."""
    proposed = found.where((F.col("kind") >= 0) & ~F.col("strict") & ~F.col("covered"))
    trees = fit(found)
    return trees.probability(proposed).where(F.col("score") >= trees.limit())


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, strict, spans) for every row: arrays of (kind, start, end) in order, in code points.

    `strict` holds the spans of the strict patterns, `spans` those and the accepted
    proposals that overlap no strict span of their kind. Null and empty texts have
    none; null ids and repeated rows are kept; an empty table gives no rows; other
    columns are ignored. Texts of any length are searched whole; a wide email ends at
    64 characters before the @, 63 in a label and 9 labels, as addresses do.
    """
    found = written(candidates(df, id_col, text_col), "candidates")
    strict = found.where((F.col("kind") < 0) | F.col("valid")).select("row", "id", "text_hash", "kind", "start", "end", F.lit(True).alias("strict"))
    strict = strict.unionByName(_accepted(found).select("row", "id", "text_hash", "kind", "start", "end", F.lit(False).alias("strict")))
    span = F.struct("kind", "start", "end")
    lists = strict.groupBy("row", "id", "text_hash").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") >= 0) & F.col("strict"), span))).alias("strict"),
        F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, span))).alias("spans"),
    )
    return lists.select(F.col("id").alias(id_col), "text_hash", "strict", "spans")


def as_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every found span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null texts stay null; null ids and repeated rows are kept; an empty table gives no
    rows; all columns are kept, whatever their names.
    """
    id_, hash_, spans_, merged_, mine = spare(df, "id", "hash", "spans", "merged", "mine")
    spans = find(df, id_col, text_col).where(F.size("spans") > 0).groupBy(F.col(id_col).alias(id_), F.col("text_hash").alias(hash_)).agg(F.max("spans").alias(spans_))
    ordered = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(-1).alias("kind"))
    # Spans that reach into the one before are joined to it.
    merged = F.aggregate(ordered, F.array(first), lambda acc, s: F.when((s["start"] < F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.element_at(acc, -1).withField("end", F.greatest(F.element_at(acc, -1)["end"], s["end"]))))).otherwise(F.concat(acc, F.array(s))))
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    text = F.col(text_col)
    cut = F.transform(merged_, lambda s, i: F.concat(F.coalesce(F.get(names, s["kind"]), F.lit("")), text.substr(s["end"].cast("int") + 1, (F.coalesce(F.get(merged_, i + 1)["start"], F.length(text)) - s["end"]).cast("int"))))
    docs = df.withColumn(mine, F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(mine) == F.col(hash_)), "left").withColumn(merged_, F.when(F.col(spans_).isNotNull(), merged))
    return joined.withColumn(text_col, F.when(F.col(merged_).isNotNull(), F.concat_ws("", cut)).otherwise(text)).select(*df.columns)
