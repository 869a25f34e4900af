"""What a user decides about people and faces. Every decision gives new tables; clustering keeps to them afterwards."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from prismlake.operators.curation import merged_groups


@dataclass(frozen=True)
class State:
    """Tables that decisions change.

    people (id, name, cover_face_id, hidden boolean), assignments (face_id, person_id, assigned_by), groups (id, name,
    avatar_face_id), members (manual_person_id, face_id), hidden_groups (manual_person_id) and
    exclusions (left_manual_person_id, right_manual_person_id). Groups hold faces together whatever clustering finds. items
    (manual_person_id, file_id) are files that users gave to a group by hand; None where there is no such table.
    """

    people: DataFrame
    assignments: DataFrame
    groups: DataFrame
    members: DataFrame
    hidden_groups: DataFrame
    exclusions: DataFrame
    items: DataFrame | None = None


def _next(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]


def _row(table: DataFrame, *values) -> DataFrame:
    return table.union(table.sparkSession.createDataFrame([values], table.schema))


def _where(table: DataFrame, hit: Column, **new) -> DataFrame:
    """table with new values in the rows that hit."""
    hit = F.coalesce(hit, F.lit(False))
    return table.select(*[F.when(hit, v if isinstance(v := new[c], Column) else F.lit(v).cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def faces_of(state: State, person: int) -> DataFrame:
    return state.assignments.where(F.col("person_id") == person).select("face_id")


def with_group(state: State, person: int) -> tuple[State, int]:
    """The group of a person, which then holds all their faces that are in none: made anew, or merged from all that they have."""
    own = state.members.join(faces_of(state, person), "face_id", "left_semi").select("manual_person_id").distinct()
    ids = sorted(r[0] for r in own.collect())  # one person's groups
    if not ids:
        group = _next(state.groups)
        state = replace(state, groups=_row(state.groups, group, None, None))
    else:
        state, group = with_merged(state, ids), ids[0]
    free = faces_of(state, person).join(state.members, "face_id", "left_anti")
    return replace(state, members=state.members.union(free.select(F.lit(group).cast("long"), "face_id"))), group


def with_merged(state: State, ids: list[int]) -> State:
    """Groups merged into the least id, which keeps its name and avatar, or takes the first of the others'."""
    ids = sorted(set(ids))
    if len(ids) < 2:
        return state
    members, apart = merged_groups(state.members, state.exclusions, ids)
    gone = F.col("id").isin(ids)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    one = state.groups.where(gone).agg(F.min("id").alias("id"), first("name"), first("avatar_face_id"))
    hide = F.when(F.col("manual_person_id").isin(ids), F.lit(ids[0])).otherwise(F.col("manual_person_id")).cast("long").alias("manual_person_id")
    items = None if state.items is None else state.items.select(hide, "file_id").distinct()
    return replace(state, items=items, members=members, exclusions=apart, groups=state.groups.where(~gone).union(one), hidden_groups=state.hidden_groups.select(hide).distinct())


def renamed(state: State, person: int, name: str) -> State:
    """A name of 1 to 128 characters for a person and their group."""
    name = name.strip()
    if not 1 <= len(name) <= 128:
        raise ValueError("a name has 1 to 128 characters")
    state, group = with_group(state, person)
    return replace(state, groups=_where(state.groups, F.col("id") == group, name=name), people=_where(state.people, F.col("id") == person, name=name))


def hidden(state: State, *persons: int) -> State:
    for p in dict.fromkeys(persons):
        state, group = with_group(state, p)
        state = replace(state, hidden_groups=_row(state.hidden_groups, group).distinct())
    return replace(state, people=_where(state.people, F.col("id").isin(list(persons)), hidden=True))


def unhidden(state: State, person: int) -> State:
    state, group = with_group(state, person)
    return replace(state, hidden_groups=state.hidden_groups.where(F.col("manual_person_id") != group), people=_where(state.people, F.col("id") == person, hidden=False))


def split(state: State, person: int) -> State:
    """Each face of a person in a group of its own, hidden if the person was; clustering then finds their people anew."""
    from pyspark.sql import Window as W

    faces = faces_of(state, person)
    if len(faces.take(2)) < 2:
        raise ValueError("a person needs two faces to be split")
    was = bool(state.people.where(F.col("id") == person).select(F.coalesce("hidden", F.lit(False))).first()[0])
    alone = faces.select((F.row_number().over(W.orderBy("face_id")) + _next(state.groups) - 1).cast("long").alias("manual_person_id"), "face_id")  # one person's faces
    groups = state.groups.union(alone.select("manual_person_id", F.lit(None).cast("string"), F.lit(None).cast("long")))
    members = state.members.join(faces, "face_id", "left_anti").select("manual_person_id", "face_id").union(alone)
    hide = state.hidden_groups.union(alone.select("manual_person_id")) if was else state.hidden_groups
    return replace(state, groups=groups, members=members, hidden_groups=hide)


def _moved(state: State, face: int, group: int, person: int) -> State:
    groups = _where(state.groups, F.col("avatar_face_id") == face, avatar_face_id=None)
    members = _row(state.members.where(F.col("face_id") != face), group, face)
    return replace(state, groups=groups, members=members, assignments=_where(state.assignments, F.col("face_id") == face, person_id=person, assigned_by="manual"))


def added_to(state: State, face: int, person: int) -> State:
    """A face moved to another person and their group."""
    state, group = with_group(state, person)
    here = state.assignments.where((F.col("face_id") == face) & (F.col("person_id") == person)).take(1)
    return _without_empty(state if here else _moved(state, face, group, person))


def separated(state: State, face: int, hide: bool = False) -> State:
    """A face as a person and a group of its own; hidden if it is no face."""
    group, person = _next(state.groups), _next(state.people)
    state = replace(state, groups=_row(state.groups, group, None, None), people=_row(state.people, person, None, face, hide))
    state = _moved(state, face, group, person)
    return _without_empty(replace(state, hidden_groups=_row(state.hidden_groups, group)) if hide else state)


def with_avatar(state: State, face: int, person: int) -> State:
    """A face of a person as their picture, also after clustering anew."""
    state, group = with_group(state, person)
    return replace(state, groups=_where(state.groups, F.col("id") == group, avatar_face_id=face), people=_where(state.people, F.col("id") == person, cover_face_id=face))


def with_avatars(state: State) -> State:
    """Pictures that users chose, given back to the people who have those faces."""
    own = state.groups.where("avatar_face_id IS NOT NULL").join(state.members, (F.col("id") == F.col("manual_person_id")) & (F.col("avatar_face_id") == F.col("face_id")), "left_semi")
    chosen = own.join(state.assignments, F.col("avatar_face_id") == F.col("face_id")).groupBy(F.col("person_id").alias("_p")).agg(F.min_by("avatar_face_id", "id").alias("_f"))
    people = state.people.join(chosen, F.col("id") == F.col("_p"), "left")
    return replace(state, people=people.select(*[F.coalesce("_f", c).alias(c) if c == "cover_face_id" else F.col(c) for c in state.people.columns]))


def merged(state: State, target: int, *others: int) -> State:
    """People merged into one, with their groups; the target's own picture stays."""
    others = tuple(dict.fromkeys(p for p in others if p != target))
    if not others:
        raise ValueError("choose somebody to merge")
    state, group = with_group(state, target)
    avatar = state.groups.where(F.col("id") == group).first()["avatar_face_id"]
    groups = [group]
    for p in others:
        state, other = with_group(state, p)
        groups.append(other)
    state = with_merged(state, groups)
    if avatar is not None:
        state = replace(state, groups=_where(state.groups, F.col("id") == min(groups), avatar_face_id=avatar))
    return _without_empty(replace(state, assignments=_where(state.assignments, F.col("person_id").isin(list(others)), person_id=target, assigned_by="manual")))


def kept_apart(state: State, one: int, other: int) -> State:
    """Two people who are never the same."""
    state, a = with_group(state, one)
    state, b = with_group(state, other)
    if a == b:
        raise ValueError("these people are merged already")
    return replace(state, exclusions=_row(state.exclusions, min(a, b), max(a, b)).distinct())


def _without_empty(state: State) -> State:
    """People without a face go."""
    return replace(state, people=state.people.join(state.assignments.select(F.col("person_id").alias("id")), "id", "left_semi").select(*state.people.columns))


def _ordered(state: State, ids: list[int], name: str) -> DataFrame:
    """Asked ids with their place, each once; a list that somebody has chosen."""
    spark = state.people.sparkSession
    return spark.createDataFrame([(int(i), k) for k, i in enumerate(dict.fromkeys(ids))], f"{name} long, place long")


def with_items(state: State, faces: DataFrame, files: DataFrame, person: int, file_ids: list[int], face_ids: list[int] = ()) -> State:
    """Files given to a person by hand, some of them by a face (faces: id, file_id) that is then theirs; files: id.

    A face of a file that is the person's already is left alone, as is a second face of a file; asked files without such a face become items of
    the person's group, unless they don't exist or are theirs already. People who lose their last face go.
    """
    state, group = with_group(state, person)
    own = people_files(state, faces).where(F.col("person_id") == person).select("file_id").distinct()
    asked = _ordered(state, face_ids, "face_id").join(faces.select(F.col("id").alias("face_id"), "file_id"), "face_id").join(state.assignments.select("face_id", "person_id"), "face_id")
    asked = asked.join(own, "file_id", "left_anti")
    chosen = asked.groupBy("file_id").agg(F.min_by(F.struct("face_id", "person_id"), "place").alias("f")).select("file_id", "f.face_id", "f.person_id")
    new = chosen.where(F.col("person_id") != person).select("face_id", F.lit(True).alias("_new"))
    both = state.assignments.join(F.broadcast(new), "face_id", "left")  # at most the faces asked for
    assignments = both.select(*[F.when(F.col("_new"), v).otherwise(F.col(c)).alias(c) if (v := {"person_id": F.lit(person), "assigned_by": F.lit("manual")}.get(c)) is not None else F.col(c) for c in state.assignments.columns])
    members = state.members.join(new, "face_id", "left_anti").select("manual_person_id", "face_id").union(new.select(F.lit(group).cast("long"), "face_id"))
    lost = state.groups.join(new.select(F.col("face_id").alias("avatar_face_id"), "_new"), "avatar_face_id", "left")
    groups = lost.select(*[F.when(F.col("_new"), None).otherwise(F.col(c)).alias(c) if c == "avatar_face_id" else F.col(c) for c in state.groups.columns])
    more = _ordered(state, file_ids, "file_id").join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("file_id")
    more = more.join(own.union(chosen.select("file_id")), "file_id", "left_anti")
    items = more.select(F.lit(group).cast("long").alias("manual_person_id"), "file_id")
    items = items if state.items is None else state.items.select("manual_person_id", "file_id").union(items).distinct()
    return _without_empty(replace(state, assignments=assignments, members=members, groups=groups, items=items))


def without_items(state: State, person: int, file_ids: list[int]) -> State:
    """Files that were given to any group of a person by hand, taken back; files with a face of theirs stay theirs."""
    if state.items is None:
        return state
    groups = state.members.join(faces_of(state, person), "face_id", "left_semi").select("manual_person_id").distinct()
    gone = state.items.join(groups, "manual_person_id", "left_semi").where(F.col("file_id").isin([int(i) for i in file_ids]))
    return replace(state, items=state.items.join(gone, ["manual_person_id", "file_id"], "left_anti"))


def people_files(state: State, faces: DataFrame) -> DataFrame:
    """(person_id, file_id): files with a face of the person, and those given to their groups by hand."""
    from prismlake.operators.people import person_files

    return person_files(state.assignments.select("face_id", "person_id"), faces, state.items, None if state.items is None else state.members)


def replaced_faces(faces: DataFrame, scans: DataFrame, new_faces: DataFrame, new_scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces and scans with all that is known of newly scanned files replaced; a scan without faces removes the old ones."""
    done = new_scans.select("file_id").distinct()
    keep = lambda old, new: old.join(done, "file_id", "left_anti").select(*old.columns).unionByName(new)
    return keep(faces, new_faces), keep(scans, new_scans)


def rebuilt(faces: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty tables: everything is scanned anew."""
    return faces.where(F.lit(False)), scans.where(F.lit(False))
