"""Personal data by candidate gradient boosting, on DataFrame functions alone.

1. Base patterns give the spans that must stay. High-recall generators propose
   further spans per kind on the text with those blanked, so that none overlaps
   a base span; all are arrays within the row, and no text is shuffled.
2. Every match has a few discrete features of its format and context. All
   matches of the corpus are counted into the cells of this feature grid (at
   most its size in rows reaches the driver, whatever the input), by whether they
   pass the check of their kind: domain shape, octets, Luhn, area and exchange
   codes. No feature restates a check. Boosted trees are fitted to those counts
   and say how often what looks like this passes.
3. A check passes by chance too (`CHANCE`). From the share that passes, less a
   standard deviation, follows which part of those that pass is genuine; a kind's
   threshold is the lowest score from which on this is at least `precision`, on
   the half of the values that the trees did not see. Few matches mean a wide
   deviation, not another rule. The trees become nested CASE expressions; a
   proposed span that reaches the threshold and passes its check is added.
   Redaction replaces each span by its kind.

Matches are written once to the shared folder, so patterns run once. Positions
come from prefix sums in blocks of the square root of a row's matches, and
redaction halves a text until few spans are left in each part, so that a text
with very many spans doesn't take quadratic time. The patterns are written with
possessive quantifiers and guards, which match what the plain patterns match,
without recursion or repeated scans of long runs.

Cases: null text is empty and has no span; equal spans of one kind count once;
without any candidate nothing is added; positions are code points, end exclusive;
repeated rows are separate; columns of the input must not begin with two
underscores, other names don't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

KINDS = ("email", "ip", "card", "phone")
_E = "A-Za-z0-9._%+-"
#: What each base pattern of the contract matches, and a cheap test that a text may have a match.
BASE = {
    "email": (rf"(?:(?<![{_E}])|\G)[{_E}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: Wider patterns: spelled-out addresses, grouped or partial numbers without a leading plus.
WIDE = {
    "email": (r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(](?:at|AT)[\])]\x20?|@)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+", r"@|[\[(](?:at|AT)[\])]"),
    "ip": (r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){2,5}+", "[0-9]\\.[0-9]"),
    "card": (r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2,3}[0-9]{0,3}(?![0-9])", r"[0-9]{4}[\x20.-]?[0-9]{4}"),
    "phone": (r"(?<![0-9+])(?:\+|00)?[0-9]{0,3}\x20?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
}
CUES = r"(?i)(?:mail|phone|tel|call|fax|contact|card|visa|host|addr|ip)[^A-Za-z]{0,4}$"
#: How often what is not of the kind passes its check: a tenth of all numbers pass Luhn, 0.8 ** 2 have such codes.
CHANCE = {"email": 0.1, "ip": 0.5, "card": 0.1, "phone": 0.64}
_BLANK = "\ufffc"
_SPAN = "array<struct<s:int,e:int,v:string,b:string,a:string>>"


def matches(df: DataFrame, name: str, text: dict[str, Column], patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """df with, per kind k: <name>_gaps_<k> (the pieces between matches) and <name>_<k>: array<struct<s, e, v, b, a>>, the matches with what stands right before and after.

    Leftmost and non-overlapping. Positions are prefix sums over gaps and
    matches: first of blocks of about sqrt(n), then within each block.
    """
    none = F.expr("cast(array() as array<string>)")
    hint = {k: text[k].rlike(h) for k, (_, h) in patterns.items()}
    df = df.withColumns(
        {f"{name}_found_{k}": F.when(hint[k], F.regexp_extract_all(text[k], F.lit(p), F.lit(0))).otherwise(none) for k, (p, _) in patterns.items()}
        | {f"{name}_gaps_{k}": F.when(hint[k], F.split(text[k], p, -1)).otherwise(none) for k, (p, _) in patterns.items()}
    )

    def items(k: str) -> Column:
        gaps = F.col(f"{name}_gaps_{k}")
        return F.transform(
            f"{name}_found_{k}",
            lambda v, i: F.struct(
                F.length(F.get(gaps, i)).alias("g"),
                F.length(v).alias("n"),
                v.alias("v"),
                F.right(F.get(gaps, i), F.lit(12)).alias("b"),
                F.left(F.get(gaps, i + 1), F.lit(1)).alias("a"),
            ),
        )

    df = df.withColumns({f"{name}_items_{k}": items(k) for k in patterns})

    def block(k: str, i: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(f"{name}_items_{k}"))).cast("int")
        return F.slice(f"{name}_items_{k}", i * size + 1, size)

    def blocks(k: str) -> Column:
        n = F.size(f"{name}_items_{k}")
        return F.sequence(F.lit(0), F.ceil(n / F.ceil(F.sqrt(n))).cast("int") - 1)

    def sums(k: str) -> Column:
        return F.transform(blocks(k), lambda i: F.aggregate(block(k, i), F.lit(0), lambda acc, x: acc + x["g"] + x["n"]))

    def starts(k: str) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        folded = F.aggregate(sums(k), zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        return F.when(F.size(f"{name}_items_{k}") > 0, folded["out"])

    df = df.withColumns({f"{name}_starts_{k}": starts(k) for k in patterns})

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + x["n"]
        span = F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"), x["b"].alias("b"), x["a"].alias("a"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(k: str) -> Column:
        def one(i: Column) -> Column:
            zero = F.struct(F.get(f"{name}_starts_{k}", i).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))
            return F.aggregate(block(k, i), zero, step)["out"]

        return F.when(F.size(f"{name}_items_{k}") > 0, F.flatten(F.transform(blocks(k), one))).otherwise(F.expr(f"cast(array() as {_SPAN})"))

    df = df.withColumns({f"{name}_{k}": placed(k) for k in patterns})
    return df.drop(*(f"{name}_{x}_{k}" for x in ("found", "items", "starts") for k in patterns))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.lit(2) * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def octets(v: Column) -> Column:
    return F.forall(F.split(v, "\\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def holds(kind: str, v: Column) -> Column:
    """The contract's condition on a match."""
    if kind == "ip":
        return octets(v)
    if kind == "card":
        n = digits(v)
        return F.length(n).between(13, 19) & luhn(n)
    if kind == "phone":
        return F.length(digits(v)).between(9, 15)
    return F.lit(True)


def genuine(kind: str, v: Column) -> Column:
    """The check of a kind on any of its formats."""
    n = digits(v)
    if kind == "email":
        return v.rlike(r"(?:\.|[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z]{2,}$")
    if kind == "ip":
        return octets(v) & (F.size(F.split(v, "\\.")) == 4)
    if kind == "card":
        return F.length(n).between(13, 19) & luhn(n)
    # The last ten digits as area code, exchange and number, unless a plus or zeros declare another country.
    foreign = v.rlike(r"^(?:\+|00)") & ~v.rlike(r"^(?:\+|00)1[^0-9]")
    return F.length(n).between(9, 15) & (foreign | n.rlike("[2-9][0-9]{2}[2-9][0-9]{6}$"))


def char_class(c: Column) -> Column:
    """0 none, 1 space, 2 letter, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike("^\\s"), 1).when(c.rlike("^\\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


FEATURES = ("digits", "length", "left", "right", "groups", "separator", "mark", "cue")
#: Largest value of each feature; the grid has at most 4 x the product of (value + 1) cells.
LIMITS = (9, 5, 4, 4, 4, 4, 1, 1)


def described(kind: str, c: Column) -> Column:
    """A match with its features, and whether it passes the check of its kind."""
    v, count = c["v"], F.length(digits(c["v"]))
    between = F.regexp_replace(v, "[A-Za-z0-9+()\\[\\]@]", "")
    separator = F.when(between == "", 0).when(between.rlike("^\\x20+$"), 1).when(between.rlike("^-+$"), 2).when(between.rlike("^\\.+$"), 3).otherwise(4)
    return F.struct(
        c["s"].alias("s"),
        c["e"].alias("e"),
        F.when(count < 4, 0).when(count < 7, 1).when(count < 9, 2).when(count < 10, 3).when(count < 11, 4).when(count < 13, 5).when(count < 14, 6).when(count < 16, 7).when(count < 17, 8).otherwise(9).alias("digits"),
        F.least(F.floor(F.length(v) / 8), F.lit(5)).cast("int").alias("length"),
        char_class(F.right(c["b"], F.lit(1))).alias("left"),
        char_class(c["a"]).alias("right"),
        F.least(F.length(between), F.lit(4)).alias("groups"),
        separator.alias("separator"),
        v.rlike("[+@]").cast("int").alias("mark"),
        c["b"].rlike(CUES).cast("int").alias("cue"),
        genuine(kind, v).cast("int").alias("passes"),
        (F.crc32(v.cast("binary")) % 2).cast("int").alias("half"),
    )


@dataclass(frozen=True)
class PiiConfig:
    trees: int = 30
    depth: int = 3
    rate: float = 0.3
    min_weight: float = 20.0
    precision: float = 0.8  # genuine ones among added spans, at the lower end of what the counts allow
    deviations: float = 1.0  # below the mean


Cell = tuple[int, ...]


def fit_trees(cells: dict[Cell, tuple[float, float]], cfg: PiiConfig) -> tuple[float, list]:
    """Logistic boosting on (positives, all) of each feature cell: the bias, and trees as nested (feature, limit, below, above) or leaf values."""
    pos, total = sum(p for p, _ in cells.values()), sum(n for _, n in cells.values())
    bias = math.log((pos + 1) / (total - pos + 1))
    score = dict.fromkeys(cells, bias)
    trees = []

    def gain(g: float, h: float) -> float:
        return g * g / (h + 1.0)

    def grow(own: list[Cell], depth: int, slope: dict, weight: dict):
        g, h = sum(slope[c] for c in own), sum(weight[c] for c in own)
        best = None
        if depth:
            for f in range(len(own[0])):
                by: dict[int, list[float]] = {}
                for c in own:
                    x = by.setdefault(c[f], [0.0, 0.0, 0.0])
                    x[0], x[1], x[2] = x[0] + slope[c], x[1] + weight[c], x[2] + cells[c][1]
                gl = hl = nl = 0.0
                keys = sorted(by)
                n = sum(x[2] for x in by.values())
                for k in keys[:-1]:
                    gl, hl, nl = gl + by[k][0], hl + by[k][1], nl + by[k][2]
                    if nl < cfg.min_weight or n - nl < cfg.min_weight:
                        continue
                    better = gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h)
                    if better > 1e-9 and (best is None or better > best[0]):
                        best = (better, f, k)
        if best is None:
            leaf = cfg.rate * g / (h + 1.0)
            for c in own:
                score[c] += leaf
            return leaf
        _, f, k = best
        return f, k, grow([c for c in own if c[f] <= k], depth - 1, slope, weight), grow([c for c in own if c[f] > k], depth - 1, slope, weight)

    for _ in range(cfg.trees if cells else 0):
        prob = {c: 1 / (1 + math.exp(-min(30.0, max(-30.0, s)))) for c, s in score.items()}
        slope = {c: cells[c][0] - prob[c] * cells[c][1] for c in cells}
        weight = {c: prob[c] * (1 - prob[c]) * cells[c][1] for c in cells}
        trees.append(grow(sorted(cells), cfg.depth, slope, weight))
    return bias, trees


def tree_value(tree, cell: Cell) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if cell[tree[0]] <= tree[1] else tree[3]
    return tree


@dataclass(frozen=True)
class PiiModel:
    bias: float
    trees: tuple
    thresholds: tuple[float, ...]  # per kind; infinite: nothing is added

    def value(self, cell: Cell) -> float:
        return self.bias + sum(tree_value(t, cell) for t in self.trees)

    def column(self, kind: int, c: Column) -> Column:
        """The score of a candidate struct; branches on the kind are resolved here."""

        def branch(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, k, low, high = tree
            if f == 0:
                return branch(low if kind <= k else high)
            return F.when(c[FEATURES[f - 1]] <= k, branch(low)).otherwise(branch(high))

        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + branch(tree)
        return out


def with_spans(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __base_<kind> (the base spans, struct<s, e>), __wide_<kind> (proposed spans with features) and __seen (kind, features, half and check of all matches), as a table in the shared folder."""
    names = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    df = matches(docs, "__raw", dict.fromkeys(KINDS, body), BASE)

    def blanked(k: str) -> Column:
        gaps = F.col(f"__raw_gaps_{k}")
        parts = F.transform(f"__raw_{k}", lambda c, i: F.concat(F.get(gaps, i), F.when(holds(k, c["v"]), F.repeat(F.lit(_BLANK), F.length(c["v"]))).otherwise(c["v"])))
        return F.when(F.size(f"__raw_{k}") == 0, body).otherwise(F.concat(F.array_join(parts, ""), F.get(gaps, F.size(parts))))

    df = df.withColumns({f"__text_{k}": blanked(k) for k in KINDS})
    df = matches(df, "__wide", {k: F.col(f"__text_{k}") for k in KINDS}, WIDE)

    def of(k: str):
        return lambda c: described(k, c)

    def valid(k: str):
        return lambda c: holds(k, c["v"])

    df = df.withColumns({f"__wide_{k}": F.transform(f"__wide_{k}", of(k)) for k in KINDS} | {f"__base_{k}": F.filter(f"__raw_{k}", valid(k)) for k in KINDS})

    def cell(i: int):
        return lambda c: F.struct(F.lit(i).alias("kind"), *(c[f] for f in (*FEATURES, "half", "passes")))

    seen = [F.transform(x, cell(i)) for i, k in enumerate(KINDS) for x in (F.transform(f"__raw_{k}", of(k)), F.col(f"__wide_{k}"))]
    base = [F.transform(f"__base_{k}", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))).alias(f"__base_{k}") for k in KINDS]
    path = scratch(spark, "pii")
    df.select(*names, *base, *(f"__wide_{k}" for k in KINDS), F.concat(*seen).alias("__seen")).write.parquet(path)
    return spark.read.parquet(path)


def fit(spanned: DataFrame, cfg: PiiConfig = PiiConfig()) -> PiiModel:
    """Count all matches of `with_spans` into feature cells, fit the trees on one half of the values and calibrate on the other."""
    cells = spanned.select(F.explode("__seen").alias("c")).select("c.*").groupBy("kind", *FEATURES, "half").agg(F.sum("passes").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    halves: tuple[dict, dict] = ({}, {})
    for r in cells:
        halves[r["half"]][(r["kind"], *(r[f] for f in FEATURES))] = (float(r["y"]), float(r["n"]))
    bias, trees = fit_trees(halves[0], cfg)
    raw = PiiModel(bias, tuple(trees), (math.inf,) * len(KINDS))
    return PiiModel(bias, tuple(trees), tuple(calibrated(raw, halves[1], i, cfg) for i in range(len(KINDS))))


def genuine_part(share: float, chance: float) -> float:
    """Of those that pass, the part that doesn't pass by chance, when `share` of all pass."""
    return max(0.0, (share - chance) / (1 - chance)) / share if share > 0 else 0.0


def precision(y: float, n: float, chance: float, deviations: float) -> float:
    """The genuine part when y of n pass: at the lower end of the share's posterior, of a prior of two passes in three."""
    a, b = y + 2, n - y + 1
    return genuine_part(a / (a + b) - deviations * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))), chance)


def calibrated(model: PiiModel, cells: dict[Cell, tuple[float, float]], kind: int, cfg: PiiConfig) -> float:
    """The lowest score from which on all have the precision: by the trees' own share, and by the counts of what scores as much or more."""
    chance = CHANCE[KINDS[kind]]
    scored = sorted(((model.value(c), y, n) for c, (y, n) in cells.items() if c[0] == kind), reverse=True)
    if not scored:
        return -math.inf if precision(0, 0, chance, cfg.deviations) >= cfg.precision else math.inf
    found, y_sum, n_sum = math.inf, 0.0, 0.0
    for value, y, n in scored:
        if genuine_part(1 / (1 + math.exp(-max(-30.0, min(30.0, value)))), chance) < cfg.precision:
            break
        y_sum, n_sum = y_sum + y, n_sum + n
        if precision(y_sum, n_sum, chance, cfg.deviations) >= cfg.precision:
            found = value
    return found


def detect(spanned: DataFrame, model: PiiModel) -> DataFrame:
    """`with_spans`' table with __all_<kind> in place of the proposed spans: arrays of struct<s, e>, base and added, by start."""

    def added(i: int, limit: float):
        return lambda c: (c["passes"] == 1) & (model.column(i, c) >= limit - 1e-9)

    done = {}
    for i, k in enumerate(KINDS):
        if model.thresholds[i] == math.inf:
            done[f"__all_{k}"] = F.col(f"__base_{k}")
        else:
            more = F.transform(F.filter(f"__wide_{k}", added(i, model.thresholds[i])), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))
            done[f"__all_{k}"] = F.array_sort(F.concat(F.col(f"__base_{k}"), more))
    return spanned.withColumns(done).drop("__seen", *(f"__wide_{k}" for k in KINDS))


def listed(prefix: str) -> Column:
    """kind:start:end of all spans, by kind as listed and start."""

    def written(kind: str):
        return lambda c: F.concat_ws(":", F.lit(kind), c["s"].cast("string"), c["e"].cast("string"))

    return F.array_join(F.concat(*(F.transform(f"{prefix}{k}", written(k)) for k in KINDS)), ",")


def replaced(text: Column, spans: Column, levels: int = 16, few: int = 16) -> Column:
    """text with each of the sorted spans (struct<s, e, tag>) replaced by its tag; overlapping spans become one, named by the first.

    Parts with more than `few` spans are halved, `levels` times at most; a span
    that reaches over the middle goes on in the right half without a tag.
    """

    def halved(p: Column) -> Column:
        half = F.floor(F.length(p["t"]) / 2).cast("int")
        mid = p["a"] + half
        left = F.struct(p["a"].alias("a"), F.left(p["t"], half).alias("t"), F.filter(p["sp"], lambda x: x["s"] < mid).alias("sp"))
        over = F.transform(
            F.filter(p["sp"], lambda x: x["e"] > mid),
            lambda x: F.struct(F.greatest(x["s"], mid).alias("s"), x["e"].alias("e"), F.when(x["s"] < mid, "").otherwise(x["tag"]).alias("tag")),
        )
        right = F.struct(mid.alias("a"), F.substring(p["t"], half + 1, F.length(p["t"])).alias("t"), over.alias("sp"))
        return F.when(F.size(p["sp"]) <= few, F.array(p)).otherwise(F.array(left, right))

    def written(p: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            piece = F.concat(acc["out"], F.substring(p["t"], acc["at"] - p["a"] + 1, x["s"] - acc["at"]), x["tag"])
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

        return F.aggregate(p["sp"], F.struct(p["a"].alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(p["t"], acc["at"] - p["a"] + 1, F.length(p["t"]))))

    parts = F.array(F.struct(F.lit(0).alias("a"), text.alias("t"), spans.alias("sp")))
    for _ in range(levels):
        parts = F.flatten(F.transform(parts, halved))
    return F.array_join(F.transform(parts, written), "")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """`detect`'s table with each span of `text` replaced by its kind in brackets, without the spans."""

    def tagged(kind: str):
        return lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("e"), F.lit(f"[{kind.upper()}]").alias("tag"))

    names = [c for c in found.columns if not c.startswith(("__base_", "__all_"))]
    spans = F.array_sort(F.concat(*(F.transform(f"__all_{k}", tagged(k)) for k in KINDS)))
    spans = F.transform(spans, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("e"), c["tag"].alias("tag")))
    held = found.withColumn("__spans", spans)
    clean = F.when(F.size("__spans") > 0, replaced(F.col(text), F.col("__spans"))).otherwise(F.col(text))
    return held.withColumn(text, clean).select(*names)


def op9_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spanned = with_spans(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    found = detect(spanned, fit(spanned))
    return found.select("doc_id", *(F.size(f"__base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(listed("__base_"), 256).alias("base_sha256"), listed("__all_").alias("spans"))


def pii_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All documents, with personal data redacted and n_chars counted anew."""
    spanned = with_spans(spark, docs)
    out = redact(detect(spanned, fit(spanned)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
