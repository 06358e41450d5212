"""Personal data by candidate generators and boosted trees, in DataFrame operations only.

*Base* spans are the leftmost non-overlapping matches of four patterns that pass their check
(IP parts at most 255, Luhn sum of cards, number of digits). A failing match is dropped and
nothing inside it is tried again.

*Candidates* come from six generators that deliberately overlap the base and one another:
addresses without a dotted host, any dotted quad, digit runs with and without separators,
phone numbers with and without a country code, assignments, and mixed runs of letters and
digits. So a card that directly follows a phone number, which no base pattern can tell apart,
is still proposed.

Every candidate is reduced to small numbers of its own format and of the two characters around
it. The candidates of *all* documents are counted by these numbers, and gradient-boosted trees
are fitted to the counts: the fit sees every document, and its input grows with the variety of
formats, not with the corpus. A candidate counts as positive if it overlaps a base span, is
assigned to a name such as ``password`` or ``token``, or has a published key prefix; none of
these facts is among the numbers the trees see, so what they learn is what such data *look* like.
For each generator the threshold is the lowest score at which, in the documents whose
crc32(doc_id) mod 5 is 0 and which the fit did not use, at least ``PRECISION`` of the candidates
are positive. Selected candidates are added; base spans always stay. A candidate that lies
within a base span or within another selected candidate adds nothing.

Null and empty texts have no spans. A null doc_id is fitted on and never held out. Rows that
repeat are treated alike. Without any positive or any candidate (an empty table, for one)
nothing is added. Equal extents: the base span stays, then the kind first in ``KINDS``.
Only ``doc_id`` and ``text`` are read, so other columns cannot clash. No step is quadratic
in a text's length; the patterns are possessive, so long runs neither overflow nor backtrack.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import saved
from barloom.llm.splits import remainder

#: The kinds in output order; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "secret")

# The base patterns, possessive. Nothing follows a repeated part that it could also
# match, so this changes no match. A run of characters is entered at its beginning or where the
# last match ended, so that a long run without a match is read once.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)

#: name, kind, pattern, and a cheap test that every text with a match passes.
GENERATORS = (
    ("address", 0, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+", "@|[\\[(]at[\\])]"),
    ("quad", 1, r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}+(?![0-9])", r"[0-9]\.[0-9]"),
    ("digits", 2, r"(?<![0-9])[0-9]{13,19}(?![0-9])", "[0-9]{13}"),
    ("grouped", 2, r"(?<![0-9])[0-9]{3,6}+(?:[\x20._/-][0-9]{2,6}+){2,5}+(?![0-9])", "[0-9]{3}[ ._/-][0-9]"),
    ("number", 3, r"(?<![0-9+])(?:\+[0-9]{1,3}+[\x20.-]?+)?+(?:\([0-9]{2,4}+\)|[0-9]{2,4}+)[\x20.-]?+[0-9]{3,4}+[\x20.-][0-9]{3,5}+(?![0-9])", "[0-9]{3}[ .-][0-9]{3}"),
    ("assigned", 4, r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_-]{2,31}+\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_-]{8,}+[\x22']?", "[=:]"),
    ("mixed", 4, r"(?<![A-Za-z0-9_])(?=[A-Za-z_-]{0,64}+[0-9])[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9_])", "[0-9]"),
)

# Names whose assigned value is secret, and published prefixes of access keys.
SECRET_NAME = r"(?i)^(?:pass|passwd|password|pwd|token|secret|api[_-]?key|access[_-]?key|auth[_-]?token)\x20?[=:]"
KEY_PREFIX = r"^(?:AKIA|ASIA|ghp_|gho_|glpat-|xox[bp]-|sk_live_)"

FEATURES = ("generator", "digits", "letters", "length", "groups", "opening", "changes", "variety", "case", "before", "after")
ROUNDS = 20
DEPTH = 4
RATE = 0.3
SEED = 11
PRECISION = 0.5
HELD = (5, 0)
_STEP = 64


# --- arrays ------------------------------------------------------------------------

def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, fold, start: Column) -> Column:
    """For every element the fold of all elements before it, in steps of 64 so that it is not quadratic."""
    def steps(v):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(_STEP)), lambda i: F.slice(v, i + 1, _STEP))

    def whole(chunks):
        return F.transform(chunks, lambda c: F.aggregate(c, start, fold))

    def inside(x):
        return F.flatten(F.transform(x["chunks"], lambda c, i: _let(
            F.aggregate(F.slice(x["whole"], 1, i), start, fold),
            lambda base: F.transform(c, lambda _, j: F.aggregate(F.slice(c, 1, j), base, fold)))))

    return _let(values, lambda v: _let(steps(v), lambda chunks: _let(
        F.struct(chunks.alias("chunks"), whole(chunks).alias("whole")), inside)))


def located(text: Column, pattern: str, test: str | None = None) -> Column:
    """All matches as ``(start, end, found, before, after)``: code points, and the characters around."""
    def places(x):
        sizes = F.transform(x["found"], lambda m, i: (F.char_length(x["parts"][i]) + F.char_length(m)).cast("long"))
        offsets = _before(sizes, lambda a, b: a + b, F.lit(0).cast("long"))
        return _let(offsets, lambda at: F.transform(x["found"], lambda m, i: F.struct(
            (at[i] + F.char_length(x["parts"][i])).alias("start"),
            (at[i] + F.char_length(x["parts"][i]) + F.char_length(m)).alias("end"),
            m.alias("found"), F.right(x["parts"][i], F.lit(1)).alias("before"), F.left(x["parts"][i + 1], F.lit(1)).alias("after"))))

    cut = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    spans = _let(cut, places)
    nothing = F.expr("cast(array() as array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>)")
    return spans if test is None else F.when(text.rlike(test), spans).otherwise(nothing)


def _passes(kind: int, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        def small(part):
            plain = F.regexp_replace(part, "^0+", "")
            return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))
        return F.forall(F.split(found, r"\."), small)
    if kind == 2:
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def base_spans(text: Column) -> Column:
    """Array of ``(start, kind, end)``, sorted."""
    tests = ("@", r"[0-9]\.[0-9]", "[0-9][ -]?[0-9]", r"\+[0-9]")

    def of_kind(k):
        passing = F.filter(located(text, BASE[k], tests[k]), lambda s: _passes(k, s["found"]))
        return F.transform(passing, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*[of_kind(k) for k in range(4)]))


# --- candidates ------------------------------------------------------------------------

def _class(char: Column) -> Column:
    """0 none, 1 white space, 2 letter, 3 digit, 4 bracket or quote, 5 other."""
    return (F.when(char == "", 0).when(char.rlike(r"^\s"), 1).when(char.rlike(r"^\p{L}"), 2).when(char.rlike("^[0-9]"), 3)
            .when(char.rlike("^[\"'()\\[\\]{}<>]"), 4).otherwise(5))


def _described(span: Column, generator: int, kind: int) -> Column:
    found = span["found"]
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(found, "[^A-Za-z]", ""))
    upper = found.rlike("[A-Z]").cast("int") + 2 * found.rlike("[a-z]").cast("int")
    first = F.left(found, F.lit(1))
    known = found.rlike(SECRET_NAME) | found.rlike(KEY_PREFIX) if kind == 4 else F.lit(False)
    numbers = {
        "generator": F.lit(generator),
        "digits": F.least(digits, F.lit(24)),
        "letters": F.when(letters < 3, letters).when(letters < 8, 3).when(letters < 16, 4).otherwise(5),
        "length": F.least(F.char_length(found) / 2, F.lit(32)).cast("int"),
        "groups": F.least(F.regexp_count(found, F.lit("[^0-9A-Za-z]+")), F.lit(6)),
        "opening": F.when(first == "+", 1).when(first == "(", 2).when(first.rlike("[0-9]"), 3).otherwise(0),
        "changes": F.least(F.regexp_count(found, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")), F.lit(8)),
        "variety": F.least(F.size(F.array_distinct(F.split(F.left(found, F.lit(64)), ""))), F.lit(20)),
        "case": upper,
        "before": _class(span["before"]),
        "after": _class(span["after"]),
    }
    return F.struct(span["start"].alias("start"), F.lit(kind).alias("kind"), span["end"].alias("end"),
                    known.alias("positive"), *[numbers[n].cast("int").alias(n) for n in FEATURES])


_FIELDS = ("start:bigint", "kind:int", "end:bigint", "positive:boolean", *[f"{n}:int" for n in FEATURES])
_PROPOSED = f"array<struct<{','.join(_FIELDS)}>>"


def _marked(base: Column, proposed: Column) -> Column:
    """The candidates, positive also where they overlap a base span; one pass over both in order of their start."""
    missing = F.expr(f"cast(null as {_PROPOSED[6:-1]})")

    def entry(s, candidate):
        return F.struct(s["start"].alias("start"), candidate.isNotNull().alias("proposed"), s["end"].alias("end"), candidate.alias("c"))

    entries = F.array_sort(F.concat(F.transform(base, lambda s: entry(s, missing)), F.transform(proposed, lambda s: entry(s, s))))
    far = F.lit(2 ** 62)

    def joined(x):
        ends = F.transform(x, lambda e: F.when(e["proposed"], F.lit(-1)).otherwise(e["end"]))
        starts = F.reverse(F.transform(x, lambda e: F.when(e["proposed"], far).otherwise(e["start"])))
        both = F.struct(x.alias("x"), _before(ends, lambda a, b: F.greatest(a, b), F.lit(-1).cast("long")).alias("reach"),
                        F.reverse(_before(starts, lambda a, b: F.least(a, b), far)).alias("next"))
        return _let(both, lambda y: F.transform(y["x"], lambda e, i: F.struct(
            e["c"].alias("c"), ((y["reach"][i] > e["start"]) | (y["next"][i] < e["end"])).alias("covered"))))

    found = F.filter(_let(entries, joined), lambda e: e["c"].isNotNull())
    names = [f.split(":")[0] for f in _FIELDS]
    return F.transform(found, lambda e: F.struct(*[
        (e["c"]["positive"] | e["covered"]).alias(n) if n == "positive" else e["c"][n].alias(n) for n in names]))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, base, proposed`` of every row; the texts are read once and not kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = docs.select(F.col("doc_id"), text.alias("text")).select("doc_id", "text", F.col("text").rlike("[0-9@=:]|[\\[(]at[\\])]").alias("any"))
    base_type = "array<struct<start:bigint,kind:int,end:bigint>>"
    based = some.select("doc_id", "text", "any", F.when(F.col("any"), base_spans(F.col("text"))).otherwise(F.expr(f"cast(array() as {base_type})")).alias("base"))

    def of_generator(g):
        _, kind, pattern, test = GENERATORS[g]
        return F.transform(located(F.col("text"), pattern, test), lambda s: _described(s, g, kind))

    proposed = F.concat(*[of_generator(g) for g in range(len(GENERATORS))])
    nothing = F.expr(f"cast(array() as {_PROPOSED})")
    return based.select("doc_id", "base", F.when(F.col("any"), _marked(F.col("base"), proposed)).otherwise(nothing).alias("proposed"))


# --- boosted trees ------------------------------------------------------------------------

def _as_column(node, value) -> Column:
    """A fitted tree as nested conditions."""
    if "Leaf" in node.getClass().getSimpleName():
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = _as_column(node.leftChild(), value), _as_column(node.rightChild(), value)
    return F.when(value(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold())), left).otherwise(right)


class Boosted:
    """Fitted trees and one threshold per generator."""

    def __init__(self, model, thresholds: dict[int, float]):
        self.model, self.thresholds = model, thresholds

    def score(self, value) -> Column:
        """The probability from the numbers that ``value(name)`` gives."""
        margin = reduce(lambda a, b: a + b, [F.lit(float(w)) * _as_column(t._call_java("rootNode"), value)
                                             for w, t in zip(self.model.treeWeights, self.model.trees)])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def selects(self, candidate: Column) -> Column:
        least = F.lit(2.0)
        for generator, threshold in self.thresholds.items():
            least = F.when(candidate["generator"] == generator, F.lit(threshold)).otherwise(least)
        return self.score(lambda name: candidate[name]) >= least


def fitted(found: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, precision: float = PRECISION) -> Boosted | None:
    """Trees fitted to the counted formats of all candidates; None if there is nothing to learn."""
    held = F.coalesce(remainder("doc_id", HELD[0]) == HELD[1], F.lit(False))
    single = found.select(held.alias("held"), F.explode("proposed").alias("c")).select("held", "c.positive", *[F.col(f"c.{n}") for n in FEATURES])
    counted = saved(single.groupBy("held", "positive", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight")), "formats")
    rows = counted.where("not held").select(F.col("positive").cast("double").alias("label"), "weight", *FEATURES)
    if rows.agg(F.max("label")).first()[0] != 1.0:
        return None
    # One order in one small partition: the sums, and so the trees, agree between reruns.
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.coalesce(1).sortWithinPartitions("label", *FEATURES))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=RATE, weightCol="weight", seed=SEED, maxBins=64).fit(table)
    boosted = Boosted(model, {})
    score = F.floor(boosted.score(F.col) * 200) / 200
    tail = counted.where("held").groupBy("generator", score.alias("score")).agg(
        F.sum(F.when(F.col("positive"), F.col("weight")).otherwise(0.0)).alias("good"), F.sum("weight").alias("all"))
    good: dict = {}
    # At most 201 scores a generator reach the driver.
    for r in tail.orderBy("generator", F.desc("score")).collect():
        g = good.setdefault(r["generator"], [0.0, 0.0])
        g[0], g[1] = g[0] + r["good"], g[1] + r["all"]
        if g[0] >= precision * g[1]:
            boosted.thresholds[r["generator"]] = float(r["score"])
    # Formats too rare for the held-out part are taken at the plain probability.
    for g in range(len(GENERATORS)):
        if g not in good:
            boosted.thresholds[g] = precision
    return boosted


# --- results ------------------------------------------------------------------------

def _outermost(spans: Column) -> Column:
    """Of ``(start, -end, added, kind)`` spans the base ones and those added that no earlier one contains."""
    def kept(s):
        reach = _before(F.transform(s, lambda x: -x["minus_end"]), lambda a, b: F.greatest(a, b), F.lit(-1).cast("long"))
        return _let(reach, lambda r: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("x"), r[i].alias("reach"))),
                                              lambda y: ~y["x"]["added"] | (y["reach"] < -y["x"]["minus_end"])))

    shown = F.transform(_let(F.array_sort(spans), kept), lambda y: F.struct(
        y["x"]["start"].alias("start"), y["x"]["kind"].alias("kind"), (-y["x"]["minus_end"]).alias("end")))
    return F.array_sort(shown)


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` of every row: arrays of ``(start, kind, end)``, kinds as places in ``KINDS``."""
    found = saved(candidates(docs), "candidates")
    boosted = fitted(found)
    def placed(s, added):
        return F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), F.lit(added).alias("added"), s["kind"].alias("kind"))

    base = F.transform("base", lambda s: placed(s, False))
    if boosted is None:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    chosen = F.transform(F.filter("proposed", boosted.selects), lambda s: placed(s, True))
    return found.select("doc_id", "base", F.when(F.size("proposed") > 0, _outermost(F.concat(base, chosen))).otherwise(F.col("base")).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The base spans counted by kind and hashed, and all spans written out."""
    found = personal_data(docs)

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch covered by spans replaced by ``[kind]`` of its first span."""
    def cut(s):
        reach = _before(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))
        names = F.array(*[F.lit(k) for k in KINDS])
        return _let(reach, lambda r: F.concat(
            F.array_join(F.transform(s, lambda x, i: F.when(x["start"] >= r[i], F.concat(
                F.substring(text, (r[i] + 1).cast("int"), (x["start"] - r[i]).cast("int")), F.lit("["), names[x["kind"]], F.lit("]"))).otherwise("")), ""),
            F.substring(text, (F.array_max(F.concat(F.array(F.lit(0).cast("long")), F.transform(s, lambda x: x["end"]))) + 1).cast("int"),
                        F.char_length(text))))

    return F.when(F.size(spans) > 0, _let(spans, cut)).otherwise(text)
