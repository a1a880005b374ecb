"""Personal data: base patterns, and further candidates judged by gradient-boosted trees, in SQL functions only.

Base kinds (email, ip, card, phone) are found by fixed patterns and checks and always stay. High-recall generators then
propose further spans, which may overlap one another: tokens that could be secrets, phone numbers without a country
code, national ids, account numbers. Each candidate has features of its format and of the words before it. Boosted
regression trees, compiled to a CASE expression, give its log odds; a logistic calibration makes them probabilities, and
each kind's threshold, set on candidates not used for the trees, selects what is reported. Of overlapping selected
candidates the likeliest stays.

Everything runs inside each row, in time about in proportion to its text: no shuffle, no Python on the executors. The trees are fitted in the driver on a fixed
set of labelled examples (``labelled_examples``, at most ``examples`` rows), whose features the same SQL computes.

Spans are [start, end) in code points. Defined cases: null and empty texts have no spans; repeated rows are each
reported; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ["email", "ip", "card", "phone"]
EXTRA = ["secret", "local_phone", "national_id", "account"]
#: Cuts a text at its matches; where a text itself holds it, another character that no pattern names stands in for it.
_MARK, _STAND_IN = chr(0xE000), chr(0xE001)
_SPANS = "array<struct<s:int,e:int,t:string,before:string>>"
#: Pieces (text between matches, match, text, match, ...) that are summed at once; even.
_BLOCK = 128

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches without recursion and in linear time. Groups repeat possessively; a match starts at the edge of its
#: run, or where the last match ended, as a later start in one run meets the same end. Of cards only runs of 13 to 19
#: digits are told, all others fail the check.
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": PATTERNS["phone"],
}
#: Cheap tests that a text must pass to hold the kind at all.
GATES = {"email": "contains(text, '@')", "ip": r"text rlike r'[0-9]\.[0-9]+\.[0-9]+\.[0-9]'", "card": r"text rlike r'[0-9][0-9\x20-]{11,}[0-9]'", "phone": "contains(text, '+')"}
CHECKS = {
    "email": "true",
    "ip": r"forall(split(x.t, r'\.'), p -> coalesce(try_cast(p as decimal(38,0)), 256) <= 255)",
    "card": "length(regexp_replace(x.t, '[^0-9]', '')) between 13 and 19 and luhn_check(regexp_replace(x.t, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.t, '[^0-9]', '')) between 9 and 15",
}
GENERATORS = {
    # Longer runs are data, such as pictures, and not secrets.
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,512}+={0,2}(?![A-Za-z0-9+/_-])",
    "local_phone": r"(?<![0-9A-Za-z.-])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
}
EXTRA_GATES = {
    "secret": r"masked rlike r'[A-Za-z0-9+/_-]{16}'",
    "local_phone": r"masked rlike r'[0-9]{3,4}[\x20.-][0-9]{3,4}'",
    "national_id": r"masked rlike r'[0-9]{3}-[0-9]{2}-[0-9]{4}'",
    "account": r"masked rlike r'[A-Z]{2}[0-9]{2}'",
}
#: Words before a candidate that speak for what it is.
CUES = {"secret": "token|key|secret|passw|pwd|auth|bearer|api|credential", "number": "phone|tel|call|mobile|cell|fax|contact|whatsapp", "id": "ssn|social|national|passport|tax|iban|account|bank|insurance", "other": "order|part|item|isbn|version|model|serial|page|commit|file|http|www"}
WINDOW = 32
#: A candidate overlaps fewer than so many of those that start before or after it: of each kind no two overlap, none is
#: longer than 514, none of a kind shorter than 16, 10, 11 and 16.
_NEAR = 176
FEATURES = {
    "kind": "x.kind",
    "size": "length(x.t)",
    "digits": "regexp_count(x.t, '[0-9]') / length(x.t)",
    "uppers": "regexp_count(x.t, '[A-Z]') / length(x.t)",
    "lowers": "regexp_count(x.t, '[a-z]') / length(x.t)",
    "kinds": "size(array_distinct(split(x.t, ''))) / length(x.t)",
    "marks": "regexp_count(x.t, '[^0-9A-Za-z]') / length(x.t)",
    "turns": "regexp_count(x.t, '[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])') / length(x.t)",
    "hexes": "regexp_count(x.t, '[0-9a-f]') / length(x.t)",
    "vowels": "regexp_count(x.t, '[aeiouAEIOU]') / length(x.t)",
    "assigned": r"""case when x.before rlike r'[=:"\x27][\x20"\x27]*$' then 1 else 0 end""",
    "prefixed": "case when x.t rlike '^(AKIA|ASIA|AIza|ghp_|gho_|github_pat_|sk-|sk_live_|xox[abps]-|glpat-|eyJ)' then 1 else 0 end",
    **{f"cue_{k}": f"case when lower(x.before) rlike '{v}' then 1 else 0 end" for k, v in CUES.items()},
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pieces(text: str, pattern: str) -> str:
    """SQL for ``text`` cut at the matches of ``pattern``: text, match, text, ..., match, text. It must not hold the mark."""
    return f"split(regexp_replace({text}, {_quoted(pattern)}, '{_MARK}$0{_MARK}'), '{_MARK}', -1)"


def _spans(text: str, pattern: str) -> str:
    """SQL for the matches of ``pattern``, leftmost and apart, with their places and up to WINDOW characters before them.

    Pieces are summed in blocks, so that no array grows by one match at a time over a whole long text.
    """
    step = f"""named_struct('pos', acc.pos + length(x), 'hit', not acc.hit, 'last', if(acc.hit, x, acc.last), 'gap', if(acc.hit, '', x),
        'out', if(acc.hit, concat(acc.out, array(named_struct('s', acc.pos, 'e', acc.pos + length(x), 't', x, 'before', right(concat(right(acc.last, {WINDOW}), right(acc.gap, {WINDOW})), {WINDOW})))), acc.out))"""
    block = f"aggregate(b.xs, named_struct('pos', o, 'hit', false, 'last', b.last, 'gap', '', 'out', cast(array() as {_SPANS})), (acc, x) -> {step}, acc -> acc.out)"
    blocks = f"transform(sequence(0, (size(p) - 1) div {_BLOCK}), i -> named_struct('xs', slice(p, i * {_BLOCK} + 1, {_BLOCK}), 'last', if(i = 0, '', p[i * {_BLOCK} - 1])))"
    starts = "aggregate(bs, array(0), (acc, b) -> concat(acc, array(element_at(acc, -1) + aggregate(b.xs, 0, (n, x) -> n + length(x)))))"
    each = f"transform(array({blocks}), bs -> flatten(zip_with(bs, slice({starts}, 1, size(bs)), (b, o) -> {block})))[0]"
    # One-element arrays name a value, which is then worked out once.
    return f"transform(array({_pieces(text, pattern)}), p -> if(size(p) < 2, cast(array() as {_SPANS}), {each}))[0]"


def _base(kind: str) -> str:
    return f"filter(case when {GATES[kind]} then {_spans('text', LINEAR[kind])} else cast(array() as {_SPANS}) end, x -> {CHECKS[kind]})"


def _masked(text: str, kind: str) -> str:
    """SQL for ``text`` with signs of no pattern in place of the kind's matches, where there are any."""
    hide = f"transform({_pieces(text, LINEAR[kind])}, (t, i) -> if(i % 2 = 1, transform(array(named_struct('t', t)), x -> if({CHECKS[kind]}, repeat('\\u0001', length(t)), t))[0], t))"
    return f"case when size({kind}) = 0 then {text} else array_join({hide}, '') end"


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, base kinds' spans, and ``found``: further candidates with their features."""
    text = f"case when contains(text, '{_MARK}') then translate(text, '{_MARK}', '{_STAND_IN}') else coalesce(text, '') end"
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.expr(text).alias("text"))
    for kind in BASE:
        rows = rows.withColumn(kind, F.expr(_base(kind)))
    rows = rows.withColumn("masked", F.col("text"))
    for kind in BASE:
        rows = rows.withColumn("masked", F.expr(_masked("masked", kind)))
    parts = []
    for i, kind in enumerate(EXTRA):
        spans = f"case when {EXTRA_GATES[kind]} then {_spans('masked', GENERATORS[kind])} else cast(array() as {_SPANS}) end"
        parts.append(f"transform({spans}, x -> named_struct('s', x.s, 'e', x.e, 'kind', {i}, 't', x.t, 'before', x.before))")
    rows = rows.withColumn("found", F.expr(f"concat({', '.join(parts)})"))
    features = ", ".join(f"'{n}', cast({e} as double)" for n, e in FEATURES.items())
    rows = rows.withColumn("found", F.expr(f"transform(found, x -> named_struct('s', x.s, 'e', x.e, {features}))"))
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *BASE, "found")


@dataclass
class Boost:
    """Boosted regression trees: each is nested (feature, threshold, left, right) or a leaf value."""

    trees: list
    bias: float
    scale: tuple[float, float]
    thresholds: list[float]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for t in self.trees:
            out += _walk(t, x)
        return out

    def sql(self, row: str = "x") -> str:
        """The calibrated probability as SQL over a struct of features."""
        names = list(FEATURES)

        def node(t) -> str:
            if not isinstance(t, tuple):
                return f"{t!r}D"
            return f"case when {row}.{names[t[0]]} <= {t[1]!r}D then {node(t[2])} else {node(t[3])} end"

        total = " + ".join([f"{self.bias!r}D", *[f"({node(t)})" for t in self.trees]])
        return f"1 / (1 + exp(-({self.scale[0]!r}D * ({total}) + {self.scale[1]!r}D)))"


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = _walk(tree[2], x[left]), _walk(tree[3], x[~left])
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0, least: int = 5):
    """A regression tree on gradients and curvatures (Newton gain)."""
    leaf = float(g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2 * least:
        return leaf
    best, split = 1e-9, None
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(g) - at - 1 >= least)]
        if not len(at):
            continue
        gain = cg[at] ** 2 / (ch[at] + ridge) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + ridge) - whole
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, split = gain[k], (f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if split is None:
        return leaf
    left = x[:, split[0]] <= split[1]
    return (*split, _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def _shrink(tree, rate: float):
    return (tree[0], tree[1], _shrink(tree[2], rate), _shrink(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.3, precision: float = 0.97) -> Boost:
    """Trees on two thirds of the rows; calibration and each kind's threshold on the rest."""
    hold = np.arange(len(y)) % 3 == 2
    model = Boost([], float(np.log((y[~hold].mean() + 1e-3) / (1 - y[~hold].mean() + 1e-3))), (1.0, 0.0), [])
    z = np.full(int((~hold).sum()), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _shrink(_grow(x[~hold], y[~hold] - p, p * (1 - p), depth), rate)
        model.trees.append(tree)
        z += _walk(tree, x[~hold])
    z, held = model.odds(x[hold]), y[hold]
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((held - p) * z).sum() - 0.1 * (a - 1), (held - p).sum() - 0.1 * b])
        hess = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, grad), -1, 1)
    model.scale = (float(a), float(b))
    p, kind = 1 / (1 + np.exp(-(a * z + b))), x[hold, 0]
    for k in range(len(EXTRA)):
        order = np.argsort(-p[kind == k], kind="stable")
        good = np.cumsum(held[kind == k][order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(good >= precision)
        model.thresholds.append(float(np.clip(p[kind == k][order][enough[-1]] if len(enough) else 0.5, 0.3, 0.95)))
    return model


def labelled_examples(examples: int = 2400, seed: int = 7) -> list[tuple[str, int]]:
    """Short invented texts with one candidate each, labelled 1 where it is private."""
    rnd = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "en", "su", "ra", "on", "di", "ve", "th", "ing"]
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    word = lambda a=1, b=4: "".join(rnd.choice(syllables) for _ in range(rnd.randint(a, b)))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = lambda n: " ".join(word() for _ in range(n))
    say = lambda *cues: rnd.choice(["", "", *cues])

    def one() -> tuple[str, int]:
        roll, sep = rnd.randrange(16), rnd.choice(" .-")
        if roll == 0:
            return say("token = \"", "api_key: ", "secret=", "password: ") + pick(digits + "abcdef", rnd.choice([24, 32, 40, 64])), 1
        if roll == 1:
            return say("key ", "aws key: ") + rnd.choice(["AKIA", "ASIA"]) + pick(upper + rnd.choice(["", digits]), 16), 1
        if roll == 2:
            return say("token ", "Bearer ", "auth=") + rnd.choice(["", "", "ghp_", "sk-", "xoxb-", "AIza"]) + pick(lower + upper + digits + "_-", rnd.randint(20, 60)), 1
        if roll == 3:
            return "".join(rnd.choice(syllables) for _ in range(rnd.randint(8, 14))), 0
        if roll == 4:
            return "-".join(word(1, 3) for _ in range(rnd.randint(4, 8))), 0
        if roll == 5:
            return rnd.choice(["=", "-", "_", "/"]) * rnd.randint(16, 60), 0
        if roll == 6:
            return say("file ", "see www.x/", "path ") + "/".join(word() for _ in range(6)) + rnd.choice(["", "/2024", "/v2"]), 0
        if roll == 7:
            return say("order ", "item ", "serial ") + pick(digits, rnd.randint(16, 24)), 0
        if roll == 8:
            return "".join(rnd.choice(syllables).upper() for _ in range(rnd.randint(8, 12))), 0
        if roll in (9, 10):
            return say("call ", "phone: ", "tel ", "mobile ") + rnd.choice([f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", f"{pick(digits, 3)}{sep}{pick(digits, 3)}{sep}{pick(digits, 4)}"]), 1
        if roll == 11:
            return rnd.choice(["pages ", "version ", "model ", "part "]) + f"{pick(digits, rnd.choice([2, 4]))}{sep}{pick(digits, rnd.choice([3, 4]))}{sep}{pick(digits, rnd.choice([3, 4]))}", 0
        if roll == 12:
            return say("ssn ", "social security number: ") + f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", 1
        if roll == 13:
            return rnd.choice(["part ", "item no ", "model ", "serial "]) + f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", 0
        if roll == 14:
            return say("iban ", "account: ", "bank ") + rnd.choice(["DE", "FR", "ES", "GB"]) + pick(digits, 2) + rnd.choice(["", " "]).join(["", *[pick(digits, 4) for _ in range(rnd.randint(4, 6))]]), 1
        return rnd.choice(["part ", "model ", "serial "]) + pick(upper, 2) + pick(digits, 2) + "".join(pick(upper + digits, 4) for _ in range(rnd.randint(3, 4))), 0

    out = []
    for _ in range(examples):
        text, label = one()
        out.append((f"{words(rnd.randint(0, 6))} {text} {words(rnd.randint(0, 4))}", label))
    return out


_models: dict[int, Boost] = {}


def model(spark: SparkSession, examples: int = 2400) -> Boost:
    """Fitted once in the driver; the examples' features come from the same SQL that scores documents."""
    if examples not in _models:
        rows = [{"doc_id": i, "text": t, "label": y} for i, (t, y) in enumerate(labelled_examples(examples))]
        table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<doc_id:long,text:string,label:int>>")))
        found = candidates(table, ["doc_id", "label"]).select("doc_id", "label", F.inline("found")).orderBy("doc_id", "s", "kind").collect()
        names = list(FEATURES)
        _models[examples] = fit(np.array([[r[n] for n in names] for r in found], float), np.array([r.label for r in found], float))
    return _models[examples]


def find(docs: DataFrame, trees: Boost | None = None) -> DataFrame:
    """(doc_id, one array of spans a base kind, extra): extra has the selected candidates (kind, s, e, p)."""
    trees = trees or model(docs.sparkSession)
    rows = candidates(docs, ["doc_id"])
    rows = rows.withColumn("scored", F.expr(f"transform(found, x -> named_struct('s', x.s, 'e', x.e, 'kind', cast(x.kind as int), 'p', {trees.sql()}))"))
    cut = " ".join(f"when {i} then {t!r}D" for i, t in enumerate(trees.thresholds))
    rows = rows.withColumn("likely", F.expr(f"array_sort(filter(scored, x -> x.p >= case x.kind {cut} end))"))
    better = "y.s < x.e and x.s < y.e and (y.p > x.p or (y.p = x.p and (y.e - y.s > x.e - x.s or (y.e - y.s = x.e - x.s and (y.kind < x.kind or (y.kind = x.kind and y.s < x.s))))))"
    near = f"slice(likely, greatest(1, i + 1 - {_NEAR}), least(i + 1, {_NEAR + 1}) + {_NEAR})"
    return rows.select("doc_id", *BASE, F.expr(f"filter(likely, (x, i) -> not exists({near}, y -> {better}))").alias("extra"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = [f"transform({k}, x -> concat('{k}:', x.s, ':', x.e))" for k in BASE]
    more = [f"transform(filter(extra, x -> x.kind = {i}), x -> concat('{k}:', x.s, ':', x.e))" for i, k in enumerate(EXTRA)]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2(array_join(concat({', '.join(listed)}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(concat({', '.join(listed + more)}), ',')").alias("spans"),
        F.expr(f"cast(size(extra) + {' + '.join(f'size({k})' for k in BASE)} as bigint)").alias("n_spans"),
    )
