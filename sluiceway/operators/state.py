"""Latest value per key, under deletes that hide writes for a horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.functions.keys import salted_key
from sluiceway.operators.pin import pin

# Fixed value: seven days. A delete at time D hides every write up to D + horizon.
HORIZON_MS = 604_800_000

KEY = ["namespace", "id"]
# Which of two writes is the later one; rows without a time come first.
ORDER = ["ts_ms", "seq", "ord", "shard"]


def latest_by_key(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The row that is last in (ts_ms, seq, ord, shard) of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("_row"))
        .select(*keys, "_row.*")
    )


def partial_state(actions: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Newest put and newest delete per key, from rows with action store or delete.

    Partial states of any parts of the input, in any order and also repeated,
    merge to the state of the whole: see ``merge_states``. A put without a time
    ranks below all that have one; a key has a put where ``put_at`` is not null.
    ``deleted`` says that there ever was a delete, also once ``del_ms`` is forgotten.
    """
    is_put, is_delete = F.col("action") == "store", F.col("action") == "delete"
    put = F.struct(*ORDER)
    return actions.filter(is_put | is_delete).groupBy(*keys).agg(
        F.max(F.when(is_put, put)).alias("put_at"),
        F.max_by("payload", F.when(is_put, put)).alias("payload"),
        F.max(F.when(is_delete, F.col("ts_ms"))).alias("del_ms"),
        F.coalesce(F.max(is_delete & F.col("ts_ms").isNotNull()), F.lit(False)).alias("deleted"),
    )


def merge_states(states: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return states.groupBy(*keys).agg(
        F.max("put_at").alias("put_at"),
        F.max_by("payload", "put_at").alias("payload"),
        F.max("del_ms").alias("del_ms"),
        F.max("deleted").alias("deleted"),
    )


def is_alive(put_at: Column, del_ms: Column, deleted: Column, horizon_ms: int = HORIZON_MS) -> Column:
    """Is there a put that no delete hides? A put without a time is hidden by any delete, also one whose time is forgotten."""
    after = F.coalesce(put_at["ts_ms"] > del_ms + horizon_ms, del_ms.isNull())
    return put_at.isNotNull() & F.when(put_at["ts_ms"].isNull(), ~deleted).otherwise(after)


def live_rows(states: DataFrame, horizon_ms: int = HORIZON_MS, keys: list[str] = KEY) -> DataFrame:
    """The visible rows of a (partial) state."""
    return states.filter(is_alive(F.col("put_at"), F.col("del_ms"), F.col("deleted"), horizon_ms)).select(
        *keys, F.col("put_at.ts_ms").alias("ts_ms"), F.col("put_at.seq").alias("seq"), "payload"
    )


def row_key() -> Column:
    """Salted key of a store, null where its id allows none. A store without a time keeps its raw id as key."""
    salted = salted_key(F.col("id"), F.col("ts_ms"))
    return F.when(F.col("action") == "store", F.coalesce(salted, F.when(F.col("ts_ms").isNull(), F.encode("id", "UTF-8"))))


def refuse_unsaltable(actions: DataFrame, where: Column | None = None) -> DataFrame:
    """Stores (of the rows ``where`` holds) that allow no row key become invalid, reason ``unsaltable``; earlier reasons stay."""
    lost = (F.col("action") == "store") & row_key().isNull()
    lost = lost if where is None else lost & F.coalesce(where, F.lit(False))
    before = F.col("reason") if "reason" in actions.columns else F.lit(None).cast("string")
    return pin(
        actions,
        {
            "action": F.when(lost, "invalid").otherwise(F.col("action")),
            "reason": F.coalesce(before, F.when(lost, "unsaltable")) if where is not None else F.when(lost, "unsaltable").otherwise(before),
        },
    )


def with_row_keys(actions: DataFrame) -> DataFrame:
    """Add ``row_key`` and refuse stores that allow none: action invalid, reason ``unsaltable``."""
    return refuse_unsaltable(actions).withColumn("row_key", row_key())


def keyed_state(
    actions: DataFrame,
    horizon_ms: int = HORIZON_MS,
    key_mode: str = "plain",
    fix_deletes: bool = False,
) -> DataFrame:
    """The table left after all stores and deletes.

    key_mode="salted" keys puts by salted row key, one row per id and day,
    while deletes still name the bare id and so miss those rows;
    ``fix_deletes`` applies them to every row of the id, a row a day. Stores that
    ``with_row_keys`` refuses are not in the table: send them to quarantine.
    ``horizon_ms=0`` is plain last-writer-wins in which a delete wins a tie.
    """
    if key_mode == "plain":
        return live_rows(partial_state(actions), horizon_ms)
    if key_mode != "salted":
        raise ValueError(f"unknown key mode {key_mode!r}")
    keyed = with_row_keys(actions)
    keys = ["namespace", "id", "row_key"]
    if not fix_deletes:
        return live_rows(partial_state(keyed.filter("action = 'store'"), keys), horizon_ms, keys)
    # One pass: states per row key, deletes under the null row key, gathered by id.
    states = partial_state(keyed, keys)
    rows = F.collect_list(F.when(F.col("put_at").isNotNull(), F.struct("row_key", "put_at", "payload")))
    per_id = states.groupBy(*KEY).agg(rows.alias("rows"), F.max("del_ms").alias("del_ms"), F.max("deleted").alias("deleted"))
    return live_rows(per_id.select(*KEY, "del_ms", "deleted", F.inline("rows")), horizon_ms, keys)


def _last_delete(actions: DataFrame) -> DataFrame:
    return actions.filter("action = 'delete'").groupBy(*KEY).agg(F.max("ts_ms").alias("del_ms"))


def drop_deleted(actions: DataFrame, horizon_ms: int = HORIZON_MS) -> DataFrame:
    """Stores (all versions) that no delete hides.

    Only the newest delete of a key matters, so each key brings one row to the
    join and a hot key meets no more than that. Null is a key like any other.
    """
    puts = actions.filter("action = 'store'")
    tombs = _last_delete(actions).filter("del_ms is not null").select(*[F.col(k).alias(f"_{k}") for k in KEY], "del_ms")
    hides = puts["ts_ms"].isNull() | (puts["ts_ms"] <= tombs["del_ms"] + horizon_ms)
    same = [puts[k].eqNullSafe(tombs[f"_{k}"]) for k in KEY]
    return puts.join(tombs, [*same, hides], "left_anti")
