"""User state as folds over event logs: likes, dislikes, albums, memberships, searches, feedback.

A log row says what happened when; a fold gives the state after all of it.  Where an event's
effect depends on its key alone, folds are aggregates with ``max_by`` and ``min``, so that events
combine before they are shuffled and late or repeated ones change nothing.  Albums and saved
searches, whose names exclude each other, are replayed owner by owner.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; of equal ones the largest row."""
    rest = [c for c in log.columns if c not in keys and c not in order]
    return log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def marked(log: DataFrame, key: str = "id", at: str = "at", on: str = "mark", images: DataFrame | None = None) -> DataFrame:
    """Keys whose last event is a mark, with its time; only those among images if these are given."""
    out = latest(log.select(key, at, on), [key], [at, on]).where(F.col(on)).select(key, at)
    return out.join(images.select(key), key, "left_semi") if images is not None else out


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Union by name, the highest version of each key; missing columns are null."""
    return latest(base.unionByName(updates, allowMissingColumns=True), keys, [version]).select(*(base.columns + [c for c in updates.columns if c not in base.columns]))


def patched(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Replace the columns where the update has a value."""
    u = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    j = base.join(u, key, "left")
    return j.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def memberships(log: DataFrame) -> DataFrame:
    """(album_id, photo_id, added_at) from (album_id, photo_id, at, added boolean).

    Adding again keeps the first time; removing forgets it, so the time is that of the
    first addition after the last removal.
    """
    keys = ["album_id", "photo_id"]
    gone = log.groupBy(*keys).agg(F.max(F.when(~F.col("added"), F.col("at"))).alias("_gone"))
    live = log.where("added").join(gone, keys).where(F.col("_gone").isNull() | (F.col("at") > F.col("_gone")))
    return live.groupBy(*keys).agg(F.min("at").alias("added_at"))


def _replayed(log: DataFrame, order: list[str], rules, out: str) -> DataFrame:
    """Replay each owner's events in order by ``rules(state, event)`` and return what is then in the state.

    A name may be given once at a time, so an event's effect depends on all before it and
    the fold has to go through them in order.  An owner's events come as a sorted stream:
    memory holds one owner's live rows, whatever the length of the log.
    """

    def run(batches):
        owner, state, first = None, {}, True

        def table(rows):
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            done = []
            for event in batch.to_pylist():
                if first or event["owner"] != owner:
                    done += state.values()
                    owner, state, first = event["owner"], {}, False
                rules(state, event)
            yield table(done)
        yield table(list(state.values()))

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(out))
    return log.repartition("owner").sortWithinPartitions("owner", *order).mapInArrow(run, out)


def _album_event(state: dict, e: dict) -> None:
    key, kind, now = e["album_id"], e["kind"], e["at"]
    name = (e["name"] or "").strip()
    if kind == "delete":
        state.pop(key, None)
        return
    album = state.get(key)
    if kind == "cover":
        if album:
            album.update(cover=e["cover"] or "", updated_at=now)
        return
    if not name or any(a["name"] == name for k, a in state.items() if k != key):
        return  # a name is needed, and nobody else's
    if kind == "create" and album is None:
        state[key] = {"owner": e["owner"], "album_id": key, "name": name, "description": e["description"] or "", "cover": "", "created_at": now, "updated_at": now}
    elif kind == "rename" and album:
        album.update(name=name, updated_at=now, **({} if e["description"] is None else {"description": e["description"]}))


def live_albums(log: DataFrame) -> DataFrame:
    """(owner, album_id, name, description, cover, created_at, updated_at) of the albums that exist after a log.

    The log has (owner, at, seq, kind, album_id, name, description, cover); kind is create,
    rename, cover or delete, and ``seq`` orders events of one time.

    * Names are trimmed.  Creating or renaming is refused, and changes nothing, with a blank
      name or one that another live album of the owner has at that time; a deleted or renamed
      album's name is free again.
    * Creating an album that exists, and anything done to one that does not, changes nothing.
      An album that is created again after a delete is a new one.
    * A rename without a description keeps it; a cover may be any photo, or none.
    """
    return _replayed(log, ["at", "seq"], _album_event, "owner long, album_id long, name string, description string, cover string, created_at timestamp_ntz, updated_at timestamp_ntz")


LONGEST_NAME = 80


def _saved_event(state: dict, e: dict) -> None:
    key = e["saved_id"]
    if e["kind"] == "delete":
        state.pop(key, None)
        return
    name = (e["name"] or "").strip()
    positives, negatives = ([p.strip() for p in e[c] or [] if p and p.strip()] for c in ("positives", "negatives"))
    refused = not 1 <= len(name) <= LONGEST_NAME or not (positives or negatives) or key in state or any(x["name"] == name for x in state.values())
    if not refused:
        state[key] = {"owner": e["owner"], "saved_id": key, "name": name, "positives": positives, "negatives": negatives, "created_at": e["at"]}


def live_searches(log: DataFrame) -> DataFrame:
    """(owner, saved_id, name, positives, negatives, created_at) of the searches that are saved after a log.

    The log has (owner, at, seq, kind, saved_id, name, positives, negatives); kind is create
    or delete.  A search is refused if its trimmed name has no or more than LONGEST_NAME
    characters, or is in use by its owner at that time, or if no prompt is left after
    trimming and dropping blank ones.
    """
    return _replayed(log, ["at", "seq"], _saved_event, "owner long, saved_id long, name string, positives array<string>, negatives array<string>, created_at timestamp_ntz")


def after_reset(log: DataFrame, resets: DataFrame, by: str) -> DataFrame:
    """Events later than the last reset of their ``by``; those never reset keep all.  Resets have (by, at)."""
    last = resets.groupBy(by).agg(F.max("at").alias("_reset"))
    return log.join(last, by, "left").where(F.col("_reset").isNull() | (F.col("at") > F.col("_reset"))).drop("_reset")


def cascade(members: DataFrame, albums: DataFrame) -> DataFrame:
    """Memberships of albums that exist."""
    return members.join(albums.select("album_id"), "album_id", "left_semi")


def album_list(albums: DataFrame, members: DataFrame) -> DataFrame:
    """Albums with their number of members, orphans included, and the member that was added first ('' without any)."""
    per = members.groupBy("album_id").agg(F.count("*").alias("member_count"), F.min(F.struct("added_at", "photo_id")).getField("photo_id").alias("first"))
    j = albums.join(per, "album_id", "left")
    return j.select("album_id", "name", F.coalesce("member_count", F.lit(0)).alias("member_count"), F.coalesce(F.col("first").cast("string"), F.lit("")).alias("first_member_id"))


def paged(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(max(0, offset)) if offset > 0 else out).limit(max(0, limit))


def saved_prompts(text: str):
    """Prompts from their JSON text; what is no array of scalars gives an empty one."""
    return F.coalesce(F.from_json(F.col(text), "array<string>", {"mode": "PERMISSIVE"}), F.expr("cast(array() as array<string>)"))
