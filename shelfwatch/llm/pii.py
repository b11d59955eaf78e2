"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Base rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers. Around them high-recall generators propose
further, overlapping candidates of each kind (obfuscated addresses, numbers without ``+``, odd groupings). Boosted trees score
each candidate by its format and context, and a threshold per kind, calibrated on documents the trees have not seen, selects
which candidates are redacted besides the base spans.

- The trees are fitted by Spark ML on the candidates of all documents, thresholds on those of a third of the documents (chosen
  by a hash) that the trees are not fitted on. Candidates that look alike are one example, weighted by their number. No table
  marks personal data, so the rules teach: a candidate is positive if, normalised ("(at)" and "(dot)" undone, cards
  without separators, a leading 00 as +), it is a valid base match. The trees do not see the checks of the rules (checksum,
  ranges) nor the signs that normalising restores, only how such spans look and where they stand. A kind with few candidates to
  calibrate on leans on those of all kinds. Where a feature has more than 32 values, Spark ML chooses the bounds it tries
  from some 10,000 examples; how good a bound is, it judges on all.
- The fitted trees become one SQL expression, so scoring happens inside the row that holds the text: no join, no shuffle, no
  Python. Texts are never moved; a long text costs its own task only.
- A match at a known place is found in time linear in the text: every pattern starts where the last match ended and repeats
  possessively.

Positions are code points, the end exclusive. Defined cases: null and empty texts have no spans; of a table without
candidates of both labels no candidate is selected; repeated documents give repeated rows; an empty table gives an empty
result. Further columns stay; one named as the result, ``pii`` unless told otherwise, is replaced, and ``redact`` reserves ``_pii``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store
from shelfwatch.llm.common import text_of

TREES, DEPTH = 10, 3
PRECISION = 0.98         # of the selected candidates among the calibration documents
POOLED = 5               # candidates that the share of all kinds counts for in the share of one
CONTEXT = 24             # code points before and after a candidate

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that they repeat possessively; none starts within a run that already failed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

# High-recall generators.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"[0-9](?:[ .-]?[0-9]){11,}+",
    "phone": r"(?:\+|(?:\G|(?<![0-9]))\(?)[0-9][ ().0-9-]{5,}[0-9]",
}

# Words near a span of some kind.
CONTEXT_WORDS = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|pay|account|host|server|address|\bip\b)"

SPAN = "struct<kind:int,start:int,end:int>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match)."""
    stepwise = F.lit(rf"\G(?s:(.*?))({pattern})")  # what lies between two matches, then the match
    lengths = F.transform(F.regexp_extract_all(text, stepwise, 0), F.length)
    ends = F.aggregate(
        lengths, F.array().cast("array<int>"),
        lambda ends, n: F.concat(ends, F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + n)))
    return F.transform(
        F.arrays_zip(ends.alias("end"), F.regexp_extract_all(text, stepwise, 2).alias("match")),
        lambda m: F.struct((m["end"] - F.length(m["match"])).alias("start"), m["end"].alias("end"), m["match"].alias("match")))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    """Whether a base match passes the rule's check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (
            F.substring(part(p), 1, 3).cast("int") <= 255))
    n = F.length(_digits(match))
    return n.between(8, 15) if kind == "phone" else F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)


def _gate(kind: str, text: Column, loose: bool) -> Column:
    """Cheap test that a text may hold a match at all."""
    if kind == "email":
        gate = F.contains(text, F.lit("@"))
        return gate | F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")) if loose else gate
    return F.contains(text, F.lit("+")) if kind == "phone" and not loose else text.rlike("[0-9]")


def base_spans(text: Column) -> Column:
    """All base spans, by kind and start: array of (kind, start, end)."""
    def of_kind(k, kind):
        valid = F.filter(matches(text, BASE[kind]), lambda m: is_valid(kind, m["match"]))
        spans = F.transform(
            valid, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(_gate(kind, text, False), spans).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)])


def of_kind(spans: Column, kind: str) -> Column:
    """The spans of one kind."""
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


FORMAT = {
    "length": lambda m: F.length(m),
    "digits": lambda m: F.length(_digits(m)),
    "letters": lambda m: F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
    "groups": lambda m: F.regexp_count(m, F.lit("[0-9]+")),
    "dots": lambda m: F.regexp_count(m, F.lit(r"\.")),
    "blanks": lambda m: F.regexp_count(m, F.lit(" ")),
    "marks": lambda m: F.regexp_count(m, F.lit("[()+-]")),
    "longest": lambda m: F.array_max(F.transform(F.split(m, "[^0-9]+"), F.length)),
    "different": lambda m: F.size(F.array_distinct(F.split(_digits(m), ""))),
}
SURROUNDINGS = {
    "before_word": lambda b, a: b.rlike(r"[\p{L}\p{N}]$").cast("int"),
    "after_word": lambda b, a: a.rlike(r"^[\p{L}\p{N}]").cast("int"),
    "before_blank": lambda b, a: b.rlike(r"(?:^|\s)$").cast("int"),
    "after_blank": lambda b, a: a.rlike(r"^(?:\s|$)").cast("int"),
    "letters_around": lambda b, a: F.length(F.regexp_replace(F.concat(b, a), r"[^\p{L}]", "")),
    "digits_around": lambda b, a: F.length(_digits(F.concat(b, a))),
    "context_word": lambda b, a: F.concat(b, F.lit(" "), a).rlike(CONTEXT_WORDS).cast("int"),
}
FEATURES = ["kind", *FORMAT, *SURROUNDINGS]


def candidates(text: Column) -> Column:
    """All candidates: array of (kind, start, end, match, x), x the features in the order of ``FEATURES``."""
    nothing = F.array().cast(f"array<struct<kind:int,start:int,end:int,match:string,x:array<double>>>")

    def described(k):
        def describe(m):
            before = F.substr(text, F.greatest(m["start"] - CONTEXT + 1, F.lit(1)), F.least(m["start"], F.lit(CONTEXT)))
            after = F.substr(text, m["end"] + 1, F.lit(CONTEXT))
            x = [F.lit(k), *[f(m["match"]) for f in FORMAT.values()], *[f(before, after) for f in SURROUNDINGS.values()]]
            return F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                            m["match"].alias("match"), F.array(*[c.cast("double") for c in x]).alias("x"))
        return describe

    return F.concat(*[
        F.when(_gate(kind, text, True), F.transform(matches(text, LOOSE[kind]), described(k))).otherwise(nothing)
        for k, kind in enumerate(KINDS)
    ])


@dataclass(frozen=True)
class Selector:
    """Trees as nested (feature, bound, left, right) with numbers at the leaves, their weights, and a threshold per kind;
    a kind without a threshold selects nothing."""

    trees: list
    weights: list[float]
    thresholds: dict[int, float]

    def score(self, x: Column) -> Column:
        def walk(node):
            if isinstance(node, float):
                return F.lit(node)
            feature, bound, left, right = node
            return F.when(x[feature] <= bound, walk(left)).otherwise(walk(right))

        margin = sum((F.lit(w) * walk(t) for w, t in zip(self.weights, self.trees)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, candidate: Column) -> Column:
        chosen = F.lit(False)
        for kind, threshold in self.thresholds.items():
            chosen = chosen | ((candidate["kind"] == kind) & (self.score(candidate["x"]) >= threshold))
        return chosen


def _tree(node):
    if node.numDescendants() == 0:
        return float(node.prediction())
    split = node.split()
    return (split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def _normalised(kind: str, match: Column) -> Column:
    """What a candidate stands for, written as the base rule wants it."""
    if kind == "email":
        spelled = F.regexp_replace(F.regexp_replace(match, r" ?[(\[]at[)\]] ?", "@"), r" ?[(\[]dot[)\]] ?", ".")
        return F.regexp_replace(spelled, " ", "")
    if kind == "card":
        return F.regexp_replace(match, "[ .-]", "")
    if kind == "phone":
        return F.regexp_replace(F.regexp_replace(match, r"^\(", ""), "^00", "+")
    return match


def _matches_rule(candidate: Column) -> Column:
    """Whether the candidate, normalised, passes the rule of its kind."""
    out = F.lit(False)
    for k, kind in enumerate(KINDS):
        exact = BASE[kind].replace(r"\G|", "")  # the lookbehind holds at the start of a string
        plain = _normalised(kind, candidate["match"])
        out = out | ((candidate["kind"] == k) & plain.rlike(f"^(?:{exact})$") & is_valid(kind, plain))
    return out


def _examples(documents: DataFrame) -> DataFrame:
    """The candidates of all documents: fold, kind, x, label, and n, how many of them there are."""
    text = F.col("text")
    telling = F.lit(False)
    for kind in KINDS:
        telling = telling | _gate(kind, text, True)  # others hold no candidate
    fold = F.pmod(F.xxhash64(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"))), F.lit(3))
    found = documents.filter(telling).select(fold.alias("fold"), F.explode(candidates(text)).alias("c"))
    return (
        found.groupBy("fold", F.col("c.kind").alias("kind"), F.col("c.x").alias("x"), _matches_rule(F.col("c")).cast("double").alias("label"))
        .agg(F.count("*").cast("double").alias("n"))
    )


def fit_selector(documents: DataFrame) -> Selector:
    """Fit trees and thresholds on the candidates of all documents."""
    examples = store(_examples(documents), "pii-candidates").withColumn("features", array_to_vector("x"))
    fitting, calibration = examples.filter("fold < 2"), examples.filter("fold = 2")
    if fitting.select("label").distinct().count() < 2:
        return Selector([], [], {})
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, maxBins=32, weightCol="n").fit(fitting)
    scored = (
        model.transform(calibration).select("kind", "label", "n", F.round(vector_to_array("probability")[1], 2).alias("score"))
        .groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()
    )  # at most 101 scores a kind
    thresholds = {}
    for score in sorted({r["score"] for r in scored}, reverse=True):
        above = [r for r in scored if r["score"] >= score]
        pooled = sum(r["good"] for r in above) / sum(r["n"] for r in above)
        for kind in range(len(KINDS)):  # a kind with few candidates leans on all
            n, good = (sum(r[c] for r in above if r["kind"] == kind) for c in ("n", "good"))
            if good + POOLED * pooled >= PRECISION * (n + POOLED):
                thresholds[kind] = score
    trees = [_tree(t._call_java("rootNode")) for t in model.trees]
    return Selector(trees, [float(w) for w in model.treeWeights], thresholds)


def find_personal_data(documents: DataFrame, selector: Selector, into: str = "pii") -> DataFrame:
    """The documents with one more column: a struct of ``base`` and ``spans``, arrays of (kind, start, end) by kind and
    start. ``spans`` holds the base spans and the selected candidates, which may overlap."""
    text = text_of()
    extra = F.transform(
        F.filter(candidates(text), selector.selects),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    found = documents.withColumn(into, base_spans(text))
    if not selector.thresholds:
        return found.withColumn(into, F.struct(F.col(into).alias("base"), F.col(into).alias("spans")))
    return found.withColumn(into, F.struct(F.col(into).alias("base"), extra.alias("extra"))).withColumn(into, F.struct(
        F.col(into)["base"].alias("base"),
        F.array_sort(F.array_distinct(F.concat(F.col(into)["base"], F.col(into)["extra"]))).alias("spans")))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(documents: DataFrame, selector: Selector) -> DataFrame:
    """The documents with each span of ``text`` replaced by its kind in brackets; of overlapping spans the first names the
    whole."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = text_of()
    spans = F.array_sort(F.transform(F.col("_pii.spans"), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("upto"))

    def step(done, s):
        apart = s["start"] >= done["upto"]
        gap = F.substr(text, done["upto"] + 1, F.greatest(s["start"] - done["upto"], F.lit(0)))
        added = F.when(apart, F.concat(gap, F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(done["text"], added).alias("text"), F.greatest(done["upto"], -s["end"]).alias("upto"))

    whole = F.aggregate(spans, start, step, lambda done: F.concat(done["text"], F.substr(text, done["upto"] + 1, F.length(text))))
    found = find_personal_data(documents, selector, into="_pii")
    return found.withColumn("text", F.when(F.col("text").isNotNull(), whole)).drop("_pii")
