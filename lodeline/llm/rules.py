"""Quality rules as weak supervision.

Each rule looks at one statistic of a text and votes good, bad, or abstains. Expectation-maximisation over the counts of
vote patterns of all documents estimates, without labels, how common good documents are and how often each rule is
right about good and about bad ones. The posterior probability that a document is good then replaces all-must-pass.

What goes to the driver is one count for each vote pattern, 3 ** len(RULES) at most, whatever the number of documents.

Defined cases: null and empty texts have no words and fail the base; repeated rows each count; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.llm.common import gather, materialize, ship, texts_of

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_REST = bytes(range(128, 192))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
#: A word of letters with one mark after it at most.
_PLAIN = re.compile(rb"(?<!\S)[A-Za-z\x80-\xff'-]+[.,;:!?]?(?!\S)")
_CLOSERS = (b".", b"!", b"?", b'"', b"'", b")")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _many(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that are found twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def statistics(text: bytes) -> tuple[list[int], dict[str, float]]:
    """The five counts, and the shares that rules look at."""
    words = text.split()
    n = len(words)
    spaces, points = _many(text, _SPACE), len(text.translate(None, _REST))
    seen: set[bytes] = set()
    dup = full = closed = 0
    for line in text.split(b"\n"):
        bare = line.strip()
        if not bare:
            continue
        full += 1
        closed += bare.endswith(_CLOSERS)
        if line in seen:
            dup += 1
        seen.add(line)
    repeat = repeated_words(words)
    counts = [n, points - spaces, _many(text, SYMBOLS), dup, repeat]
    some, chars = max(n, 1), max(points - spaces, 1)
    letters = max(1, _many(text, _LETTERS))
    twins = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    return counts, {
        "words": float(n),
        "mean": chars / some,
        "symbols": counts[2] / some,
        "dup_lines": dup / max(full, 1),
        "repeat": repeat / some,
        "upper": _many(text, _UPPER) / letters,
        "closed": closed / max(full, 1),
        "bangs": text.count(b"!") / some,
        "twins": twins / some,
        "plain": len(_PLAIN.findall(text)) / some,
    }


@dataclass(frozen=True)
class Rule:
    """Votes good up to ``good`` and bad from ``bad`` on (the other way round where good > bad); abstains between."""

    name: str
    good: float
    bad: float

    def vote(self, x: float) -> int:
        if self.good <= self.bad:
            return 1 if x <= self.good else 2 if x >= self.bad else 0
        return 1 if x >= self.good else 2 if x <= self.bad else 0


RULES = [
    Rule("symbols", 0.05, 0.15),
    Rule("plain", 0.9, 0.7),
    Rule("dup_lines", 0.05, 0.3),
    Rule("repeat", 0.1, 0.3),
    Rule("twins", 0.05, 0.15),
    Rule("upper", 0.15, 0.3),
    Rule("bangs", 0.05, 0.2),
    Rule("closed", 0.5, 0.0),
    Rule("mean", 9.0, 12.0),
]


def describe(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, counts, pattern): pattern has each rule's vote (0 abstains, 1 good, 2 bad) as a base-3 digit."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("pattern", T.LongType())])

    def run(batches):
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(1)):
                counts, shares = statistics(text)
                rows.append([*counts, sum(r.vote(shares[r.name]) * 3**i for i, r in enumerate(rules))])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(COUNTS) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class LabelModel:
    prior: float  # share of good documents
    right: np.ndarray  # [rule, 0]: a voting rule says good of a good one; [rule, 1]: bad of a bad one

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes (0 abstains, 1 good, 2 bad)."""
        good, bad = self.right[:, 0], self.right[:, 1]
        odds = np.log(self.prior / (1 - self.prior))
        odds = odds + (votes == 1) @ np.log(good / (1 - bad)) + (votes == 2) @ np.log((1 - good) / bad)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def votes_of(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n_rules) % 3


def fit(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over pattern counts.

    It starts from rules that seldom misfire on good documents and catch one bad one in five; good documents' votes
    stay right more often than not, which fixes the labels' sense.
    """
    votes = votes_of(patterns, n_rules)
    model = LabelModel(0.7, np.tile([0.98, 0.2], (n_rules, 1)))
    for _ in range(rounds):
        p = model.posterior(votes)
        good, bad = counts * p, counts * (1 - p)
        prior = float(np.clip((good.sum() + 1) / (counts.sum() + 2), 0.02, 0.98))
        said_good, said_bad = votes == 1, votes == 2
        right = np.stack([(good @ said_good + 4) / (good @ (said_good | said_bad) + 5), (bad @ said_bad + 4) / (bad @ (said_good | said_bad) + 5)], axis=1)
        # A bad document looks fine to most rules, so a rule's word on bad ones may be right seldom.
        right = np.stack([np.clip(right[:, 0], 0.55, 0.995), np.clip(right[:, 1], 0.01, 0.995)], axis=1)
        new = LabelModel(prior, right)
        if abs(new.prior - model.prior) + np.abs(new.right - model.right).max() < 1e-9:
            break
        model = new
    return model


def judge(docs: DataFrame, rules: list[Rule] | None = None, minimum: float = 0.5) -> DataFrame:
    """(doc_id, counts, posterior, base_failed, kept) of each row."""
    rules = RULES if rules is None else rules
    spark = docs.sparkSession
    rows = materialize(gather(describe(docs, rules)), "rules")
    seen = rows.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** len(rules) rows
    patterns = np.array([r[0] for r in seen], np.int64)
    model = fit(patterns, np.array([r[1] for r in seen], np.float64), len(rules))
    values = model.posterior(votes_of(patterns, len(rules)))
    verdicts = spark.createDataFrame([(int(k), float(v)) for k, v in zip(patterns, values, strict=True)], "pattern long, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.join(F.broadcast(verdicts), "pattern", "left").withColumn("base_failed", failed)
    return out.select("doc_id", *COUNTS, "posterior", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= minimum)).alias("kept"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", F.col("posterior"))
