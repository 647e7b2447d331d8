"""Quality classifier as a sparse rule ensemble.

1. Statistics of every whole text (counts of bytes, words, lines, character
   classes, repeated words and lines): one pass, a narrow table.
2. A shallow random forest on labelled rows; every root-to-node path is a
   conjunctive rule over the statistics.
3. Lasso logistic weights on the rules and on the clipped statistics; most
   become zero.
4. The surviving rules are compiled into one Spark column expression, and all
   rows are scored by it inside code generation.

The models are fitted on at most ``SAMPLE`` labelled rows; statistics, rules
and scores cover every row.

Defined results: null text is empty and gets the score of its statistics (all
zero); labels that are null are ignored, several for one id count by majority
(a tie is 1); without labels of both kinds the score is the share of label 1
(0.5 without any label); repeated rows each keep theirs; an empty table gives
an empty result; other columns pass through, names beginning with ``_q_`` are
reserved.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import map_batches, sample_rows, spool

SAMPLE = 20_000
TREES, DEPTH = 24, 3
LASSO = 0.001
PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STATS = ["chars", "words", "mean_word", "long_word", "upper", "digit", "space", "high", "punct", "symbol", "bang",
         "pipe", "dot", "comma", "angle", "slash", "distinct", "top_word", "top_pair", "repeat_word", "lines",
         "mean_line", "repeat_line", "letter_end", "top_byte", "title"]


# ------------------------------------------------------------ statistics

def statistics(text: bytes) -> list[float]:
    """The values of STATS for one text."""
    if not text:
        return [0.0] * len(STATS)
    n = len(text)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    w = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    punct = int(by[list(PUNCT)].sum())
    letters = max(int(by[65:91].sum() + by[97:123].sum()), 1)
    filled = [x for x in lines if x.strip()]
    ends = sum(x[-1:] in b".!?:\"'" for x in filled)
    return [float(n), float(len(words)), float(sizes.mean()), float((sizes > 14).mean()),
            by[65:91].sum() / letters, by[48:58].sum() / n, (by[32] + by[9:14].sum()) / n, by[128:].sum() / n,
            punct / n, by[list(b"#$%&*+=@^~")].sum() / w, by[33] / w, by[124] / w, by[46] / w, by[44] / w,
            (by[60] + by[62]) / w, by[47] / w, len(seen) / w, max(seen.values(), default=0) / w,
            max(pairs.values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:])) / w,
            float(len(lines)), n / len(lines), 1 - len(set(filled)) / max(len(filled), 1),
            ends / max(len(filled), 1), by.max() / n, sum(x[:1].isupper() for x in words) / w]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with a DOUBLE column ``_q_<name>`` for each statistic."""
    carried = [c for c in docs.columns if c != "text" and not c.startswith("_q_")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in carried)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        grid = np.array([statistics(t or b"") for t in texts], np.float64).reshape(-1, len(STATS))
        return pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in carried),
                                *(pa.array(np.ascontiguousarray(grid[:, i])) for i in range(len(STATS)))],
                               [*carried, *("_q_" + s for s in STATS)])
    return map_batches(docs.select(*carried, "text"), run, schema + ", ".join(f"_q_{s} double" for s in STATS))


# ------------------------------------------------------------------ model

@dataclass(frozen=True)
class Rules:
    """score = 1 / (1 + exp(-(intercept + sum of weights))).

    ``rules``: (weight, ((statistic, lower, upper), ...)): the weight counts
    where every statistic lies in (lower, upper]. ``linear``: (weight,
    statistic, lower, upper): the statistic clipped to [lower, upper].
    """
    intercept: float
    rules: tuple = ()
    linear: tuple = ()

    def column(self) -> Column:
        z = F.lit(float(self.intercept))
        for weight, parts in self.rules:
            z = z + F.when(_holds(parts), F.lit(weight)).otherwise(F.lit(0.0))
        for weight, stat, lower, upper in self.linear:
            z = z + F.lit(weight) * F.greatest(F.least(F.col("_q_" + stat), F.lit(upper)), F.lit(lower))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _holds(parts) -> Column:
    out = F.lit(True)
    for stat, lower, upper in parts:
        c = F.col("_q_" + stat)
        if lower is not None:
            out = out & (c > F.lit(lower))
        if upper is not None:
            out = out & (c <= F.lit(upper))
    return out


def _paths(node, held: dict) -> set:
    """Rules of all nodes below the root of one tree."""
    out = set()
    if held:
        out.add(tuple(sorted((s, *b) for s, b in held.items())))
    if node.numDescendants() == 0:
        return out
    split = node.split()
    stat, cut = STATS[split.featureIndex()], split.threshold()
    lower, upper = held.get(stat, (None, None))
    out |= _paths(node.leftChild(), {**held, stat: (lower, cut)})
    out |= _paths(node.rightChild(), {**held, stat: (cut, upper)})
    return out


def fit(rows: DataFrame, seed: int = 11) -> Rules:
    """Rules from rows of statistics with a 0/1 column ``_q_label``."""
    count = {int(r[0]): r[1] for r in rows.groupBy("_q_label").count().collect()}
    if not count.get(0) or not count.get(1):
        p = 0.5 if not count else (0.999 if count.get(1) else 0.001)
        return Rules(float(np.log(p / (1 - p))))
    stats = ["_q_" + s for s in STATS]
    data = VectorAssembler(inputCols=stats, outputCol="_q_x").transform(rows).select(
        F.col("_q_label").cast("double").alias("_q_label"), "_q_x", *stats)
    forest = RandomForestClassifier(labelCol="_q_label", featuresCol="_q_x", numTrees=TREES, maxDepth=DEPTH,
                                    minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=seed).fit(data)
    rules = sorted(set().union(*(_paths(t._call_java("rootNode"), {}) for t in forest.trees)), key=repr)
    bounds = rows.approxQuantile(stats, [0.025, 0.975], 0.005)
    linear = [(s, *b) for s, b in zip(STATS, bounds) if b[1] > b[0]]
    terms = [F.when(_holds(r), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules]
    terms += [F.greatest(F.least(F.col("_q_" + s), F.lit(hi)), F.lit(lo)) for s, lo, hi in linear]
    names = [f"_q_t{i}" for i in range(len(terms))]
    grid = VectorAssembler(inputCols=names, outputCol="_q_z").transform(
        rows.select("_q_label", *[t.alias(n) for t, n in zip(terms, names)])).select("_q_label", "_q_z")
    model = LogisticRegression(labelCol="_q_label", featuresCol="_q_z", elasticNetParam=1.0, regParam=LASSO,
                               maxIter=60).fit(grid)
    w = model.coefficients.toArray()
    return Rules(float(model.intercept),
                 tuple((float(a), r) for a, r in zip(w[:len(rules)], rules) if a),
                 tuple((float(a), *s) for a, s in zip(w[len(rules):], linear) if a))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE
             ) -> DataFrame:
    """``docs`` (without text) with ``score``.

    ``labels``: (doc_id, quality); only rows of ``docs`` for which the column
    expression ``train`` holds may teach."""
    sp = spool(spark)
    stats = sp.put(with_statistics(docs))
    marks = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_q_id"))
             .agg((F.avg("quality") >= 0.5).cast("int").alias("_q_label")))
    taught = stats.filter(train).join(marks, F.col("doc_id") == F.col("_q_id"))
    few = sp.put(sample_rows(taught, "_q_label", "doc_id", sample // 2)
                 .select("_q_label", *["_q_" + s for s in STATS]))
    rules = fit(few.coalesce(4))
    return stats.withColumn("score", rules.column()).drop(*["_q_" + s for s in STATS])
