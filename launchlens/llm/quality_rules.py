"""Quality rules: text statistics, and an ordered list of threshold rules learned from labelled ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from launchlens.llm import words as W

STAT_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_lines long, n_upper long, n_marks long, n_digits long, n_distinct long"
#: Bound of the labelled rows that rules are learned from.
LABELLED_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"


def block_stats(texts: list[bytes]) -> np.ndarray:
    """Columns of STAT_SCHEMA for each text of a block."""
    n = len(texts)
    w = W.split(texts)
    out = np.zeros((n, 11), np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    b = w.bounds()
    out[:, 0] = np.diff(b)

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[np.minimum(first[1:], len(flag))] - total[first[:-1]]

    data = w.data
    head = (data & 0xC0) != 0x80  # first bytes of code points
    if len(data):
        space = W.byte_classes()[data] == 0
        out[:, 1] = per_text(head & ~space)
        out[:, 2] = per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
        out[:, 5] = per_text(head) - np.concatenate([np.ones(n - 1, np.int64), [0]])
        out[:, 7] = per_text((data >= 65) & (data <= 90))
        marks = W.byte_classes("tokens")[data] == 2
        out[:, 8] = per_text(marks)
        out[:, 9] = per_text((data >= 48) & (data <= 57))
    for d, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(b"\t\n\x0b\x0c\r ")]
        out[d, 3], out[d, 6] = len(lines) - len(set(lines)), len(lines)
    doc, h = W.shingles(w, 3, short=False)
    if len(h):
        with np.errstate(over="ignore"):
            key = W.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        # the windows are listed in the order of their first words
        at = np.flatnonzero(w.doc[: len(w.hash) - 2] == w.doc[2:])
        twice = at[counts[inverse] > 1]
        covered = np.zeros(len(w.hash), bool)
        for j in range(3):
            covered[twice + j] = True
        out[:, 4] = np.add.reduceat(np.concatenate([covered, [False]]).astype(np.int64), np.minimum(b[:-1], len(covered))) * (np.diff(b) > 0)
    if len(w.hash):
        with np.errstate(over="ignore"):
            _, at = np.unique(W.mix(w.hash + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        out[:, 10] = np.bincount(w.doc[at], minlength=n)
    return out


def text_stats(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """_keys, a struct of the columns `keys`, and the statistics of every whole text; null texts count as empty, every row stays."""
    names = [x.split()[0] for x in STAT_SCHEMA.split(", ")]
    source = docs.select(F.struct(*keys).alias("_keys"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    types = f"_keys {source.schema['_keys'].dataType.simpleString()}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = []
            for rows in W.blocks(W.arrow_rows([batch.select([1])], "_text"), 0):
                got.append(block_stats([r[0] for r in rows]))
            stats = np.concatenate(got) if got else np.zeros((0, len(names)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(stats[:, k]) for k in range(len(names)))], names=["_keys", *names])

    return source.mapInArrow(run, f"{types}, {STAT_SCHEMA}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


#: Shares that rules may test, as Spark expressions over the statistics.
def features() -> dict[str, Column]:
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_chars", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "mark_share": F.col("n_marks") / chars,
        "digit_share": F.col("n_digits") / chars,
        "distinct_share": F.col("n_distinct") / words,
        "words_per_line": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    """feature >= threshold, or feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.97, min_rows: int = 8, max_conditions: int = 4, cuts: int = 64, seed: int = 7) -> list[Rule]:
    """Sequential covering of the bad rows by conjunctions of thresholds.

    Two thirds of the rows grow a rule: conditions are added by the information they gain about
    bad rows until none is left that the rule takes wrongly. The other third prunes it: trailing conditions go
    while that does not lower (p - n) / (p + n). A rule enters the list only if both
    parts together give it `min_precision` over `min_rows` rows; rows that it covers are
    set aside for the next. Rows and rules are in a fixed order, so equal input gives equal rules.
    """
    n = len(bad)
    if not n or bad.all() or not bad.any():
        return []
    grow_part = np.random.default_rng(seed).random(n) < 2 / 3
    open_rows = np.ones(n, bool)
    rules: list[Rule] = []
    while (open_rows & bad).sum() >= min_rows:
        rule: list[Condition] = []
        covered = open_rows & grow_part
        while len(rule) < max_conditions:
            p, m = (covered & bad).sum(), covered.sum()
            if p == 0 or p == m:
                break
            best, gain = None, 1e-9
            base = np.log2(p / m)
            for name in x:
                values = np.unique(np.quantile(x[name][covered], np.linspace(0, 1, cuts)))
                for above in (True, False):
                    for t in values:
                        c = Condition(name, above, float(t))
                        hit = covered & c.holds(x)
                        hp, hm = (hit & bad).sum(), hit.sum()
                        if hp >= min_rows / 2 and (g := hp * (np.log2(hp / hm) - base)) > gain:
                            best, gain = c, g
            if best is None:
                break
            rule.append(best)
            covered &= best.holds(x)
        if not rule:
            break
        check = open_rows & ~grow_part

        def worth(conditions: Sequence[Condition], check: np.ndarray = check) -> float:
            hit = check.copy()
            for c in conditions:
                hit &= c.holds(x)
            p = (hit & bad).sum()
            return (2 * p - hit.sum()) / max(hit.sum(), 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = open_rows.copy()
        for c in rule:
            hit &= c.holds(x)
        if hit.sum() < min_rows or (hit & bad).sum() < min_precision * hit.sum():
            break
        rules.append(tuple(rule))
        open_rows &= ~hit
    return rules


def rejecting(rules: Sequence[Rule]) -> Column:
    """The decision list as one ordered conditional expression: number of the first rule that fits, else null."""
    feats = features()
    out = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        test = F.lit(True)
        for c in rules[k]:
            test = test & ((feats[c.feature] >= c.threshold) if c.above else (feats[c.feature] <= c.threshold))
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS, **options: float) -> list[Rule]:
    """Rules from at most `limit` labelled rows that pass the base rule, the first by a hash of doc_id.

    Contradicting or null labels of a document are left out. What reaches the
    driver is `limit` rows of ten numbers.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_q2"))
    chosen = one.where("_q = _q2").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    # the sample is at most `limit` rows of 16 bytes
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "_q")), "doc_id")
    stats = text_stats(joined, ["doc_id", "_q"]).where(~base_failed())
    rows = stats.select("_keys.doc_id", "_keys._q", *[c.alias(n) for n, c in features().items()]).toPandas().sort_values(["doc_id", "words", "word_length"], kind="stable")
    return learn({n: rows[n].to_numpy(float) for n in features()}, rows["_q"].to_numpy() == 0, **options)


def apply_rules(docs: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """_keys (a struct of `keys`), the statistics, base_failed, rule (number of the rejecting rule or null) and kept."""
    return text_stats(docs, list(keys)).withColumns({"base_failed": base_failed(), "rule": rejecting(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """One row per row of `docs`: doc_id, the statistics, base_failed, rule, kept.

    Null texts are empty: all counts 0, base_failed. Null ids and repeated rows stay as rows
    of their own. Without labels of both kinds the list is empty and only the base rule
    rejects. An empty table gives no rows. Other columns are ignored.
    """
    out = apply_rules(docs, fit(docs, labels, **options))
    return out.select("_keys.*", *[c for c in out.columns if c != "_keys"])
