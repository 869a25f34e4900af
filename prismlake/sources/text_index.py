"""A full-text index on disk: segments of postings sorted by word, delete markers, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prismlake.operators.clustering import cut
from prismlake.operators.search import bm25_scores, index_words, phrase_terms, word_begins
from prismlake.sources.tablesets import Snapshot, TableSet

#: Bytes of a row group of postings; the least and greatest word of each are in the footer, so a search skips the others.
GROUP_BYTES = 1 << 22
#: Postings of one file, about.
FILE_ROWS = 20_000_000


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """(key, word, tf, len) of rows (key, _words): a row's words are sorted and counted by themselves, so nothing is shuffled."""
    own = rows.where(F.size("_words") > 0).select(key, F.sort_array("_words").alias("w"), F.size("_words").alias("len"))
    last = lambda i: (i == F.col("len")) | (F.get("w", i - 1) != F.get("w", i))
    own = own.withColumn("ends", F.filter(F.sequence(F.lit(1), F.col("len")), last))
    runs = F.transform("ends", lambda e, k: F.struct(F.get("w", e - 1).alias("word"), (e - F.coalesce(F.get("ends", k - 1), F.lit(0))).cast("long").alias("tf")))
    return own.select(key, "len", F.explode(runs).alias("r")).select(key, "r.word", "len", "r.tf")


class TextIndex:
    """Postings (key, word, tf, len) and lengths (key, len) of texts in numbered segments, of which a table set holds all.

    An update writes what is new as one more segment and marks older rows of its keys as deleted; nothing that is written changes.
    `compact` merges segments. Every step is one commit, so searches see all of it or nothing, and a batch that is
    given twice under one number is taken once.
    """

    def __init__(self, tables: TableSet, key: str = "file_id", fan: int = 4, file_rows: int = FILE_ROWS, group_bytes: int = GROUP_BYTES):
        self.tables, self.key, self.fan, self.file_rows, self.group_bytes = tables, key, fan, file_rows, group_bytes

    @staticmethod
    def segments(s: Snapshot) -> list[int]:
        return sorted(int(n.split("_")[1]) for n in s.tables if n.startswith("postings_"))

    def _live(self, s: Snapshot, kind: str, segments: list[int], where: Column | None = None) -> DataFrame | None:
        """Rows of a kind of some segments that no later segment has replaced; the condition is on the scan."""
        parts = [s.table(f"{kind}_{n}").where(F.lit(True) if where is None else where).withColumn("_segment", F.lit(n)) for n in segments]
        if not parts:
            return None
        rows, gone = reduce(DataFrame.unionByName, parts), s.table("deleted").withColumnRenamed(self.key, "_gone")
        return rows.join(gone, (F.col(self.key) == F.col("_gone")) & (F.col("_segment") <= F.col("upto")), "left_anti").drop("_segment")

    def _sorted(self, postings: DataFrame, rows: int) -> DataFrame:
        return postings.repartitionByRange(max(1, -(-rows // self.file_rows)), "word", self.key).sortWithinPartitions("word", self.key)

    def _told(self, new: Snapshot, number: int, lost: tuple[int, int]) -> dict:
        got = new.table(f"lengths_{number}").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        old = new.notes.get("texts", 0), new.notes.get("words", 0)
        sizes = {**new.notes.get("sizes", {}), str(number): new.table(f"postings_{number}").count()}
        return {"texts": old[0] - lost[0] + got[0], "words": old[1] - lost[1] + got[1], "sizes": sizes, "last": number}

    def update(self, rows: DataFrame, text: str = "text", gone: DataFrame | None = None, batch: int | None = None) -> Snapshot:
        """Add rows (key, text), each in the place of an earlier one of its key, and remove the keys of `gone`.

        Rows with null text are removed, rows with null key left out; a key comes once. A `batch` not above the last one changes nothing.
        """
        s = self.tables.latest()
        if batch is not None and s.notes.get("batch", -1) >= batch:
            return s
        number = s.notes.get("last", -1) + 1
        # texts are cut into words once, for all that follows
        rows = cut(rows.where(F.col(self.key).isNotNull()).select(self.key, index_words(F.col(text)).alias("_words")))
        changed = rows.select(self.key) if gone is None else rows.select(self.key).union(gone.select(self.key))
        lengths = rows.where("_words IS NOT NULL").select(self.key, F.size("_words").alias("len"))
        words = _counted(rows, self.key)
        old = self._live(s, "lengths", self.segments(s))
        out = {f"lengths_{number}": lengths, f"postings_{number}": self._sorted(words, words.count()).select(self.key, "word", "tf", "len")}
        lost = (0, 0)
        if old is None:
            out["deleted"] = changed.limit(0).withColumn("upto", F.lit(0))
        else:
            replaced = old.join(changed.distinct(), self.key, "left_semi")
            lost = tuple(replaced.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first())
            out["deleted"] = s.table("deleted").unionByName(replaced.select(self.key, F.lit(number - 1).alias("upto"))).groupBy(self.key).agg(F.max("upto").alias("upto"))
        told = lambda new: {**self._told(new, number, lost), **({} if batch is None else {"batch": batch})}
        return self.tables.commit(s, out, notes=told, options={"parquet.block.size": str(self.group_bytes)})

    def compact(self, whole: bool = False) -> Snapshot:
        """Merge the newest segments into one, as far back as none left over is `fan` times as large as all newer ones together, or all of them.

        Each posting is so written about log(size) times. Markers stay as long as there are older segments for them.
        """
        s = self.tables.latest()
        segments, sizes = self.segments(s), s.notes.get("sizes", {})
        first, total = len(segments), 0
        while first and (whole or first == len(segments) or sizes[str(segments[first - 1])] < self.fan * max(total, 1)):
            first -= 1
            total += sizes[str(segments[first])]
        mine = segments[first:]
        if len(mine) < 2 and not (whole and mine):
            return s
        number = s.notes["last"] + 1
        live = lambda kind: self._live(s, kind, mine)
        out = {f"lengths_{number}": live("lengths"), f"postings_{number}": self._sorted(live("postings"), total)}
        out["deleted"] = s.table("deleted").where("upto < 0") if not first else s.table("deleted").withColumn("upto", F.least("upto", F.lit(segments[first - 1])))
        removed = tuple(f"{kind}_{n}" for kind in ("lengths", "postings") for n in mine)
        told = lambda new: {"sizes": {**{k: v for k, v in sizes.items() if int(k) not in mine}, str(number): new.table(f"postings_{number}").count()}, "last": number}
        return self.tables.commit(s, out, removed, told, {"parquet.block.size": str(self.group_bytes)})

    def postings_of(self, query: str, s: Snapshot | None = None) -> DataFrame | None:
        """Live postings of all words that begin like a term of the query; other row groups aren't read."""
        s = s or self.tables.latest()
        begins = [word_begins(t) for t in phrase_terms(query)]
        return self._live(s, "postings", self.segments(s), reduce(Column.__or__, begins)) if begins else None

    def search(self, query: str) -> DataFrame:
        """(key, score) as `bm25` gives them over all live texts; smaller (more negative) is better."""
        s, terms = self.tables.latest(), phrase_terms(query)
        found = self.postings_of(query, s)
        if found is None:
            kind = s.table(f"lengths_{self.segments(s)[0]}").schema[self.key].dataType.simpleString() if self.segments(s) else "long"
            return s.spark.createDataFrame([], f"{self.key} {kind}, score double")
        hit = found.groupBy(self.key, "len").agg(*[F.sum(F.when(word_begins(t), F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
        n, words = s.notes["texts"], s.notes["words"]
        df = hit.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).withColumns({"n": F.lit(n), "avg_len": F.lit(words / max(n, 1))})
        return bm25_scores(hit.crossJoin(F.broadcast(df)), self.key, len(terms))  # one row of figures
