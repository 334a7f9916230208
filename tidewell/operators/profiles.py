"""User profiles: moving averages of clicked documents, by user or by context, and their removal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context_key(session: Column, time_of_day: Column, device: Column) -> Column:
    """Session before time of day before device; null without any."""
    tagged = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}:"), c))
    return F.coalesce(tagged("session", session), tagged("time", time_of_day), tagged("device", device))


def time_of_day(at: Column) -> Column:
    h = F.hour(at)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h >= 18, "evening").otherwise("night")


def moved(state, n: int, vector, fast: float, slow: float, warm: int):
    """The average after one more vector; the first starts it, later ones leave it at length one."""
    v = np.asarray(vector, dtype=float)
    if state is None:
        return v
    a = fast if n < warm else slow
    state = (1 - a) * state + a * v
    length = np.sqrt(np.cumsum(state * state)[-1]) if len(state) else 0.0  # summed in order, whatever the machine
    return state / length if length > 0 else state


def profile_updates(clicks: DataFrame, doc_vectors: DataFrame, keys: list[str], fast: float = 0.5, slow: float = 0.05, warm: int = 10) -> DataFrame:
    """keys, vector, click_count, profile_version after all clicks in order of (created_at, event_id).

    The average is a chain, so a key's clicks go to one task, sorted; they pass in batches, and only the average is held,
    however long a history is.
    """
    joined = clicks.select(*keys, "created_at", "event_id", F.col("clicked_doc_id").alias("doc_id")).join(doc_vectors.select("doc_id", "vector"), "doc_id")
    dealt = joined.repartition(*keys).sortWithinPartitions(*keys, "created_at", "event_id").select(*keys, "vector")

    def fold(batches):
        key, state, n = None, None, 0
        row = lambda: {**dict(zip(keys, key)), "vector": state.tolist(), "click_count": n, "profile_version": n}
        for pdf in batches:
            done = []
            for *here, vector in pdf.itertuples(index=False, name=None):
                if key is None or any(a != b and not (a != a and b != b) for a, b in zip(here, key)):  # a null may come as NaN
                    if n:
                        done.append(row())
                    key, state, n = here, None, 0
                state, n = moved(state, n, vector, fast, slow, warm), n + 1
            if done:
                yield pd.DataFrame(done)
        if n:
            yield pd.DataFrame([row()])

    types = dict(joined.dtypes)
    return dealt.mapInPandas(fold, ", ".join(f"{k} {types[k]}" for k in keys) + ", vector array<double>, click_count long, profile_version long")


def with_profile(requests: DataFrame, context: DataFrame, default: DataFrame) -> DataFrame:
    """query_id, profile_vector: the context's profile, else the user's, where it has clicks; null is a cold start."""
    c = context.where("click_count > 0 and vector is not null").select("user_id", "context_key", F.col("vector").alias("cv"))
    d = default.where("click_count > 0 and vector is not null").select("user_id", F.col("vector").alias("dv"))
    return requests.join(c, ["user_id", "context_key"], "left").join(d, "user_id", "left").select("query_id", F.coalesce("cv", "dv").alias("profile_vector"))


def forget(profiles: DataFrame, contexts: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles with those of the named users reset, and contexts without theirs. Doing it again changes nothing."""
    named = users.select("user_id").distinct().withColumn("named", F.lit(True))
    joined = profiles.join(named, "user_id", "left")
    kept = lambda c, v: F.when(F.col("named"), v).otherwise(F.col(c)).alias(c)
    reset = joined.select("user_id", kept("vector", F.lit(None)), kept("click_count", F.lit(0).cast("long")), kept("profile_version", F.lit(0).cast("long")))
    return reset, contexts.join(named, "user_id", "left_anti")


def expired_sessions(contexts: DataFrame, cutoff: str) -> DataFrame:
    return contexts.where(F.col("context_key").startswith("session:") & (F.col("updated_at") < F.lit(cutoff).cast("timestamp_ntz")))
