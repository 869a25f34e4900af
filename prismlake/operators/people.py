"""Queries over people: counts, suggestions, similar people, and who is in which file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from prismlake.operators.clustering import _matrix as matrix
from prismlake.operators.filters import person_query


def person_files(assignments: DataFrame, faces: DataFrame, manual_items: DataFrame | None = None, manual_faces: DataFrame | None = None) -> DataFrame:
    """(person_id, file_id), each pair once: files with a face of the person, and files added by hand to a group of theirs."""
    own = assignments.join(faces.select(F.col("id").alias("face_id"), "file_id"), "face_id").select("person_id", "file_id")
    if manual_items is not None and manual_faces is not None:
        groups = manual_faces.join(assignments, "face_id").select("manual_person_id", "person_id").distinct()
        own = own.union(groups.join(manual_items, "manual_person_id").select("person_id", "file_id"))
    return own.distinct()


def counts(people: DataFrame, files: DataFrame, assignments: DataFrame) -> DataFrame:
    """people with item_count and face_count, 0 for none; each side is counted before it is joined."""
    items = files.groupBy("person_id").agg(F.count("*").alias("item_count"))
    faces = assignments.groupBy("person_id").agg(F.count("*").alias("face_count"))
    out = people.join(items, people["id"] == items["person_id"], "left").drop("person_id")
    out = out.join(faces, out["id"] == faces["person_id"], "left").drop("person_id")
    return out.withColumn("item_count", F.coalesce("item_count", F.lit(0))).withColumn("face_count", F.coalesce("face_count", F.lit(0)))


def page(people: DataFrame, query: str = "", include_hidden: bool = False, minimum: int = 0, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of counted people, most items first, with the total of all that match (also beyond the last page)."""
    shown = people.where(person_query(query) & (F.col("item_count") >= minimum))
    shown = shown if include_hidden else shown.where(~F.coalesce(F.col("hidden").cast("boolean"), F.lit(False)))
    total = shown.agg(F.count("*").alias("total"))
    some = shown.orderBy(F.desc("item_count"), F.desc("face_count"), "id").offset(max(offset, 0)).limit(min(max(limit, 1), 500))
    return some.crossJoin(F.broadcast(total))


def _pair() -> tuple[Column, Column]:
    return F.least("person_a", "person_b").alias("first"), F.greatest("person_a", "person_b").alias("second")


def pairs(suggestions: DataFrame, assignments: DataFrame) -> DataFrame:
    """(first, second, score): best score between two people over suggested face matches, each pair in one order."""
    a = assignments.select(F.col("face_id"), F.col("person_id").alias("person_a"))
    b = assignments.select(F.col("face_id").alias("candidate_face_id"), F.col("person_id").alias("person_b"))
    both = suggestions.join(a, "face_id").join(b, "candidate_face_id").where("person_a <> person_b")
    return both.groupBy(*_pair()).agg(F.max("score").alias("score"))


def excluded(exclusions: DataFrame, manual_faces: DataFrame, assignments: DataFrame) -> DataFrame:
    """(first, second): people whose groups must stay apart."""
    group = manual_faces.join(assignments, "face_id").select("manual_person_id", "person_id").distinct()
    left = group.select(F.col("manual_person_id").alias("left_manual_person_id"), F.col("person_id").alias("person_a"))
    right = group.select(F.col("manual_person_id").alias("right_manual_person_id"), F.col("person_id").alias("person_b"))
    return exclusions.join(left, "left_manual_person_id").join(right, "right_manual_person_id").select(*_pair()).distinct()


def next_suggestion(best: DataFrame, apart: DataFrame, counted: DataFrame, minimum: int = 1) -> DataFrame:
    """The pair to ask about next: both with enough items, the larger lesser count first, then the score, then the ids."""
    c = counted.select("id", "item_count", "hidden").where(~F.coalesce(F.col("hidden").cast("boolean"), F.lit(False)))
    one = c.select(F.col("id").alias("first"), F.col("item_count").alias("n1"))
    two = c.select(F.col("id").alias("second"), F.col("item_count").alias("n2"))
    open_ = best.join(apart, ["first", "second"], "left_anti").join(one, "first").join(two, "second")
    open_ = open_.withColumn("least", F.least("n1", "n2")).where(F.col("least") >= minimum)
    return open_.orderBy(F.desc("least"), F.desc("score"), "first", "second").limit(1)


def similar(best: DataFrame, apart: DataFrame, person: int) -> DataFrame:
    """(person_id, score): people suggested as the same as one, but for those that must stay apart."""
    open_ = best.join(apart, ["first", "second"], "left_anti")
    both = open_.select("first", "second", "score").union(open_.select("second", "first", "score"))
    return both.where(F.col("first") == person).groupBy(F.col("second").alias("person_id")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "person_id")


def for_files(files: DataFrame, ids: DataFrame, preferred: int | None = None) -> DataFrame:
    """(person_id, n): the person in most of the files; a preferred person wins if in any. files: (person_id, file_id)."""
    n = files.join(ids.select("file_id").distinct(), "file_id", "left_semi").groupBy("person_id").agg(F.count("*").alias("n"))
    return n.orderBy((F.col("person_id") == F.lit(preferred if preferred is not None else -1)).desc(), F.desc("n"), "person_id").limit(1)


def status(files: DataFrame, faces: DataFrame, assignments: DataFrame, person: int, file: int) -> DataFrame:
    """(has_face, has_item): whether a person has a face in a file, and whether the file is theirs at all."""
    own = faces.where(F.col("file_id") == file).join(assignments.where(F.col("person_id") == person), faces["id"] == assignments["face_id"], "left_semi")
    any_ = files.where((F.col("person_id") == person) & (F.col("file_id") == file))
    return own.agg((F.count("*") > 0).alias("has_face")).crossJoin(any_.agg((F.count("*") > 0).alias("has_item")))


def in_file(faces: DataFrame, assignments: DataFrame, people: DataFrame, file: int) -> DataFrame:
    """(person_id, name, face_count, avatar_face_id) of people with a face in a file; the cover, else the best face there."""
    own = faces.where(F.col("file_id") == file).join(assignments, faces["id"] == assignments["face_id"])
    per = own.groupBy("person_id").agg(F.count("*").alias("face_count"), F.max_by("face_id", F.struct("recognition_quality", -F.col("face_id"))).alias("best"))
    return per.join(people, per["person_id"] == people["id"]).select("person_id", "name", "face_count", F.coalesce("cover_face_id", "best").alias("avatar_face_id")).orderBy("person_id")


def covers(people: DataFrame, assignments: DataFrame, faces: DataFrame) -> DataFrame:
    """people whose cover_face_id, where it isn't a face of theirs any more, is their face of best quality (then least id)."""
    best = assignments.join(faces, assignments["face_id"] == faces["id"]).groupBy("person_id").agg(F.max_by("face_id", F.struct("recognition_quality", -F.col("face_id"))).alias("best"))
    own = assignments.select(F.col("person_id").alias("p"), F.col("face_id").alias("f"))
    out = people.join(best, people["id"] == best["person_id"], "left").join(own, (F.col("id") == F.col("p")) & (F.col("cover_face_id") == F.col("f")), "left")
    return out.select(*[c for c in people.columns if c != "cover_face_id"], F.when(F.col("f").isNotNull(), F.col("cover_face_id")).otherwise(F.col("best")).alias("cover_face_id"))


#: Most candidates and most targets that one task holds, and how many pairs of blocks are wanted at least.
BLOCK, PAIRS = 32768, 64


def _best_of_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """(file_id, face_id, score): the best face of each file among a block's candidates against its targets.

    A matrix product finds which pairs come within rounding of a file's best; these are summed again term by term, so that
    scores and ties don't hang on how a product is cut into tiles. Equal vectors are compared once.
    """
    out = pd.DataFrame({"file_id": pd.Series(dtype="int64"), "face_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
    pdf = pdf.sort_values("face_id", ignore_index=True)
    x, is_target = matrix(pdf["embedding"]) + 0.0, pdf["target"].to_numpy(bool)
    if is_target.all() or not is_target.any():
        return out
    text = pd.Series([v.tobytes() for v in x])
    y = x[is_target][~text[is_target].duplicated().to_numpy()]
    own = pdf[~is_target].assign(text=text[~is_target]).drop_duplicates(["file_id", "text"])
    x, (file, names) = x[own.index], pd.factorize(own["file_id"])
    rows = range(0, len(x), max(1, 4_000_000 // len(y)))
    step = rows.step
    best = np.full(len(names), -np.inf)
    high = np.empty(len(x))
    with np.errstate(all="ignore"):
        for a in rows:
            high[a : a + step] = (x[a : a + step] @ y.T).max(1)
        high[np.isnan(high)] = np.inf
        np.maximum.at(best, file, high)
        room = 1e-12 * np.sqrt((x * x).sum(1).max() * (y * y).sum(1).max())
        room = room if np.isfinite(room) else np.inf
        least = np.where(np.isfinite(best), best - room, best)
        near = np.flatnonzero(high >= least[file])
        score = np.full(len(near), -np.inf)
        for k, i in enumerate(near.tolist()):
            s = y @ x[i]
            some = y[(s >= high[i] - room) | ~np.isfinite(s)] if np.isfinite(high[i]) else y
            total = np.zeros(len(some))
            for j in range(x.shape[1]):
                total += some[:, j] * x[i, j]
            score[k] = np.nan if np.isnan(total).any() else total.max()
    got = pd.DataFrame({"file": file[near], "face_id": own["face_id"].to_numpy()[near], "score": score, "nan": np.isnan(score)})
    got = got.sort_values(["file", "nan", "score", "face_id"], ascending=[True, False, False, True]).drop_duplicates("file")
    return pd.DataFrame({"file_id": np.asarray(names)[got["file"]], "face_id": got["face_id"].to_numpy(), "score": got["score"].to_numpy()})


def best_by_file(candidates: DataFrame, targets: DataFrame, least: float = 0.58, min_targets: int = 2, block: int | None = None) -> DataFrame:
    """(file_id, face_id, score, suggested): each file's face that is most like any target face, the least of equally like ones.

    candidates: (file_id, face_id, embedding); targets: (face_id, embedding) of one person. Both are dealt to blocks by hash, and each pair of
    blocks is one task, which gives one row for a file. Each candidate is compared with each target, so work grows with both.
    """
    n, m = targets.count(), candidates.count()
    size = block or int(min(BLOCK, max(1024, (n * m / PAIRS) ** 0.5)))
    deal = lambda k: F.pmod(F.xxhash64("face_id"), F.lit(k)).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left, right = max(1, -(-m // size)), max(1, -(-n // size))
    ids = [F.col(c).cast("long").alias(c) for c in ("file_id", "face_id")]
    asked = candidates.where("embedding IS NOT NULL").select(*ids, "embedding", F.lit(False).alias("target"), deal(left).alias("i"), all_of(right).alias("j"))
    sought = targets.where("embedding IS NOT NULL").select(F.lit(None).cast("long").alias("file_id"), ids[1], "embedding", F.lit(True).alias("target"), deal(right).alias("j"), all_of(left).alias("i"))
    scored = asked.unionByName(sought).groupBy("i", "j").applyInPandas(_best_of_block, "file_id long, face_id long, score double")
    # files whose faces have no vector are there too
    scored = scored.unionByName(candidates.where(F.lit(n > 0)).select(*ids, F.lit(None).cast("double").alias("score")))
    best = scored.groupBy("file_id").agg(F.max_by("face_id", F.struct("score", -F.col("face_id"))).alias("face_id"), F.max("score").alias("score"))
    return best.withColumn("suggested", (F.col("score") >= least) & F.lit(n >= min_targets))


def addable(own: DataFrame, files: DataFrame, faces: DataFrame) -> DataFrame:
    """(file_id, kind) of files that somebody asks to add to a person: `already` theirs (own: file_id), `faces` to choose from, or `no_face`."""
    seen = faces.select("file_id", F.lit(True).alias("_face")).distinct()
    mine = own.select("file_id", F.lit(True).alias("_own")).distinct()
    kind = F.when(F.col("_own"), "already").when(F.col("_face"), "faces").otherwise("no_face")
    return files.select("file_id").distinct().join(seen, "file_id", "left").join(mine, "file_id", "left").select("file_id", kind.alias("kind"))


_BOX = ("box_left", "box_top", "box_width", "box_height")


def faces_in_file(faces: DataFrame, assignments: DataFrame, file: int, person: int | None = None) -> DataFrame:
    """(face_id, person_id, box) of a file's faces, best first."""
    own = faces.where(F.col("file_id") == file).join(assignments, faces["id"] == assignments["face_id"])
    own = own if person is None else own.where(F.col("person_id") == person)
    return own.orderBy(F.desc("recognition_quality"), "face_id").select("face_id", "person_id", *_BOX)


def faces_of_person(faces: DataFrame, assignments: DataFrame, files: DataFrame, person: int) -> DataFrame:
    """(face_id, file_id, box, width, height) of a person's faces, best first, with the size of their images."""
    own = faces.join(assignments.where(F.col("person_id") == person), faces["id"] == assignments["face_id"])
    size = files.select(F.col("id").alias("file_id"), "width", "height")
    return own.join(size, "file_id").orderBy(F.desc("recognition_quality"), "face_id").select("face_id", "file_id", *_BOX, "width", "height")


def face_metrics(faces: DataFrame, assignments: DataFrame, file: int, person: int) -> DataFrame:
    """(confidence, quality, box) of a person's best face in a file."""
    own = faces.where(F.col("file_id") == file).join(assignments.where(F.col("person_id") == person), faces["id"] == assignments["face_id"])
    best = own.orderBy(F.desc("recognition_quality"), F.desc("detector_confidence"), "face_id").limit(1)
    return best.select(F.col("detector_confidence").alias("confidence"), F.col("recognition_quality").alias("quality"), *_BOX)
