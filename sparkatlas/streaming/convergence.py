"""Convergence of research sessions: novelty, its running mean and the verdict to stop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkatlas.functions import prose
from sparkatlas.operators.models import Embedder, HashingEmbedder

BUDGET = 12


def ema(df: DataFrame, by: str, order: list[str], rate: str, budget: int = BUDGET) -> DataFrame:
    """(by, n, ema) over the first ``budget`` rates: their mean for two, then 0.3 x + 0.7 of the mean before."""
    w = Window.partitionBy(by).orderBy(*order)
    first = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget)
    rates = F.transform(F.array_sort(F.collect_list(F.struct("_n", rate))), lambda x: x[rate])
    step = lambda acc, x: F.struct((acc["n"] + 1).alias("n"), F.when(acc["n"] == 0, x).when(acc["n"] == 1, (acc["e"] + x) / 2).otherwise(0.3 * x + 0.7 * acc["e"]).alias("e"))
    return first.groupBy(by).agg(F.count("*").alias("n"), F.aggregate(rates, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("e")), step, lambda acc: acc["e"]).alias("ema"))


# Limits of the verdict, and its reasons from the hardest to the softest.
TEXT_CHARS = 1500
SENTENCE_CHARS = 20
SAME_RESULT = 0.83
SAME_SENTENCE = 0.70
NOTHING_NEW = 0.05
LITTLE_NEW = 0.10
SHARE_OF_MEAN = 0.5
WEIGHT = 0.3

OUTPUT = (
    "session string, n long, query string, cycle string, cosine double, semantic_cycle boolean, novelty double, novel_sentences long, n_sentences long, "
    "novel_entities long, n_entities long, novel_citations long, n_citations long, mean double, stop boolean, reason string"
)
STATE = "n long, mean double, queries array<string>, results array<double>, sentences array<double>, entities array<string>, citations array<string>"


def cycle_of(query: str, earlier: list[str]) -> str:
    """'exact' if the query came before, 'substring' if it holds an earlier one or lies in one, else 'none'."""
    if query in earlier:
        return "exact"
    return "substring" if any(query in q or q in query for q in earlier) else "none"


def verdict(n: int, cycle: str, semantic: bool, novelty: float, mean: float | None, budget: int = BUDGET) -> tuple[bool, str]:
    """Whether to stop at the n-th query, and why; mean: that of the rates before, known from the third query on."""
    falling = mean is not None and novelty < SHARE_OF_MEAN * mean
    met = {
        "hard_stop:query_and_semantic_cycle": cycle == "exact" and semantic,
        "hard_stop:semantic_cycle_no_novelty": semantic and novelty < NOTHING_NEW,
        "hard_stop:budget_exhausted": n >= budget,
        "soft_stop:diminishing_returns": falling and novelty < LITTLE_NEW,
        "soft_stop:saturation": n >= 3 and novelty < NOTHING_NEW,
    }
    return next(((True, reason) for reason, holds in met.items() if holds), (False, "continue"))


def closest(vecs: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Per vector of unit length the largest cosine to an earlier one, 0 at least."""
    return (vecs @ earlier.T).max(axis=1, initial=0.0)


#: Hours, by the queries' own times, by which a query may be late, and after which a session without one is forgotten.
KEPT_HOURS = 24.0


def checker(model: Embedder, kept_hours: float = KEPT_HOURS) -> Callable[[tuple[str], Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def vectors(texts: list[str]) -> np.ndarray:
        return np.array(model.embed([t[:TEXT_CHARS] for t in texts]), float).reshape(len(texts), model.width)

    def check(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """One session's queries in order of time; the state holds what the first ``BUDGET`` of them brought, until it times out."""
        if state.hasTimedOut:
            state.remove()
            return
        n, mean, queries, results, sentences, entities, citations = state.get if state.exists else (0, 0.0, [], [], [], [], [])
        queries, entities, citations = list(queries), set(entities), set(citations)
        results, sentences = (np.array(list(v), float).reshape(-1, model.width) for v in (results, sentences))
        rows = []
        queue = pd.concat(list(batches)).sort_values(["ts", "query"], kind="stable")
        for r in queue.itertuples():
            n += 1
            query = (r.query or "").lower()
            cycle = cycle_of(query, queries)
            result = vectors([r.result or ""])
            cosine = float(closest(result, results)[0])
            said = vectors([s for s in r.sentences if len(s) >= SENTENCE_CHARS])
            new = int((closest(said, sentences) < SAME_SENTENCE).sum())
            novelty = new / len(said) if len(said) else 1.0
            before = mean if n >= 3 else None
            named, cited = set(r.entities), set(r.citations)
            stop, reason = verdict(n, cycle, cosine > SAME_RESULT, novelty, before)
            rows.append((key[0], n, r.query, cycle, cosine, cosine > SAME_RESULT, novelty, new, len(said), len(named - entities), len(named), len(cited - citations), len(cited), before, stop, reason))
            mean = novelty if n == 1 else (mean + novelty) / 2 if n == 2 else WEIGHT * novelty + (1 - WEIGHT) * mean
            if n <= BUDGET:
                queries.append(query)
                results, sentences = np.concatenate((results, result)), np.concatenate((sentences, said))
                entities |= named
                citations |= cited
        state.update((n, mean, queries, results.ravel().tolist(), sentences.ravel().tolist(), sorted(entities), sorted(citations)))
        last = int(queue["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + int(kept_hours * 3_600_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return check


def converge(stream: DataFrame, model: Embedder | None = None, kept_hours: float = KEPT_HOURS) -> DataFrame:
    """Signals and a verdict per query of a stream (session, ts, query, result text).

    Sentences, names and citations are expressions; only vectors are compared in Python. The state of a
    session is bounded by the budget: later queries are answered (budget_exhausted) but not kept. A session without a query for
    ``kept_hours`` is forgotten once the watermark is past, and begins anew if it comes back.
    """
    text = F.coalesce("result", F.lit(""))
    names = F.array_distinct(F.transform(prose.proper_nouns(text), lambda x: F.lower(x)))
    signals = stream.select("session", "ts", "query", "result", prose.sentences(text).alias("sentences"), names.alias("entities"), prose.author_years(text).alias("citations"))
    return signals.withWatermark("ts", f"{max(1, int(kept_hours * 3600))} seconds").groupBy("session").applyInPandasWithState(checker(model or HashingEmbedder(), kept_hours), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
