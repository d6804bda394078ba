"""Records of delimited files whose quoted fields may hold line breaks, read by as many tasks as there are splits.

Where a split begins, nobody knows yet whether a quoted field is open. So each split is read under both assumptions at once, which gives
two end states; composing these from the start of a file on tells the true state at every border. A second pass then puts lines together
to records, and what crosses a border is stitched from its fragments: the end of one split, whole splits in between, the start of
another. A split contributes at most two fragments, however long the file is.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits whose states still go to every task; beyond it lines meet them in a shuffle by split.
MOST_SENT = 200_000
#: Places of records within a split have 33 bits.
ROWS_PER_SPLIT = 1 << 33


def open_after(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether a quoted field is open after the line. A quote opens a field at its start only; two quotes inside stand for one."""
    at, start = 0, True
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == b'"':
                at += 2
            else:
                inside, start, at = False, False, at + 1
        elif start and line[at:at + 1] == b'"':
            inside, at = True, at + 1
        else:
            at = line.find(delimiter, at)
            if at < 0:
                return False
            at, start = at + len(delimiter), True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as bytes, by file and split; ``at`` rises within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))


def _by_split(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Splits of a task with their lines; the lines of one have to be read before the next."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(columns + 1))))
    row = next(rows, None)
    while row is not None:
        key = row[:columns]

        def lines() -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[:columns] == key:
                yield row[columns]
                row = next(rows, None)
        yield key, lines()


def split_states(lines: DataFrame, delimiter: str) -> DataFrame:
    """``file, start, place, opened, owner``: of every split its number in the file, whether it begins inside a quoted field, and the
    split in which that field's record began. A file whose last quote is never closed is an error."""
    mark = delimiter.encode()

    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), own in _by_split(batches, 2):
            states, closes = [False, True], False
            for line in own:
                if b'"' in line:
                    states = [open_after(line, s, mark) for s in states] if states[0] != states[1] else [open_after(line, states[0], mark)] * 2
                closes = closes or not states[1]
            yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "after_outside": [states[0]], "after_inside": [states[1]], "closes": [closes]})

    def compose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        opened, owner, out = False, 0, []
        for place, r in enumerate(rows):
            out.append({"file": r["file"], "start": r["start"], "place": place, "opened": opened, "owner": owner})
            # a record that is open at the end began in the last split that saw an end of a record, or began outside
            owner = owner if opened and not r["closes"] else place
            opened = r["after_inside"] if opened else r["after_outside"]
        if opened:
            raise ValueError(f"{rows[0]['file']}: a quoted field is never closed")
        return pa.Table.from_pylist(out, schema)

    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("opened", pa.bool_()), ("owner", pa.int64())])
    found = lines.select("file", "start", "line").mapInArrow(
        speculate, "file string, start bigint, after_outside boolean, after_inside boolean, closes boolean")
    # a row for each split: those of a file fit one task whatever its size
    return found.groupBy("file").applyInArrow(compose, "file string, start bigint, place bigint, opened boolean, owner bigint")


def read_records(spark: SparkSession, path: str, delimiter: str, most_sent: int = MOST_SENT) -> DataFrame:
    """``file, place, header, record``: every record as bytes, its place (rising by file name and position, not without gaps), and whether
    it is the first of its file.

    Line ends inside quoted fields are kept; a carriage return before the end of a record is not part of it. Blank lines before the
    first record are left out, later ones are records of nothing. A quoted field that is never closed is an error, as nothing after
    it can be told apart.
    """
    mark, lines = delimiter.encode(), _lines(spark, path)
    rows = split_states(lines, delimiter).limit(most_sent + 1).collect()
    if len(rows) <= most_sent:
        states = spark.sparkContext.broadcast({(r["file"], r["start"]): (r["place"], r["opened"], r["owner"]) for r in rows})
        placed, columns = lines.select("file", "start", "line"), 2
    else:
        states = None
        names = ["file", "start", "place", "opened", "owner"]
        placed = lines.join(split_states(lines, delimiter), ["file", "start"]).repartition("file", "start") \
            .sortWithinPartitions("file", "start", "at").select(*names, "line")
        columns = 5

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                              ["file", "owner", "nth", "part", "text"])

        for key, own in _by_split(batches, columns):
            file, start = key[:2]
            place, opened, owner = states.value[file, start] if states is not None else key[2:]
            inside, held, nth, head = opened, [], 0, opened
            for line in own:
                if not (held or head or nth or place or line.strip()):
                    continue
                held.append(line)
                if b'"' in line:
                    inside = open_after(line, inside, mark)
                if inside:
                    continue
                text = b"\n".join(held)
                # a record that began before is a fragment of its owner, which closes it; others are whole
                out.append((file, owner, -1, place, text) if head else (file, place, nth, -1, text))
                nth, head, held, size = nth + (not head), False, [], size + len(text)
                if size > 1 << 22 or len(out) >= 10_000:
                    yield emit()
                    out, size = [], 0
            if held:
                out.append((file, owner if head else place, -1 if head else nth, place, b"\n".join(held)))
        if out:
            yield emit()

    found = placed.mapInArrow(stitch, "file string, owner bigint, nth bigint, part bigint, text binary")
    whole = found.where("part < 0").select("file", (F.col("owner") * F.lit(ROWS_PER_SPLIT) + F.col("nth")).alias("place"), F.col("text").alias("record"))
    # the stitched record is the last of its split; it has at most one fragment from each split
    parts = found.where("part >= 0").groupBy("file", "owner").agg(F.max("nth").alias("nth"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    joined = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1))), F.col("parts")[0]["text"],
                         lambda a, b: F.concat(a, F.lit(b"\n"), b["text"]))
    stitched = parts.select("file", (F.col("owner") * F.lit(ROWS_PER_SPLIT) + F.col("nth")).alias("place"), joined.alias("record"))
    ended = F.when(F.substring("record", -1, 1) == F.lit(b"\r"), F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    # a row for each file, of which Spark's own listing is on the driver anyway
    sizes = split_states(lines, delimiter).groupBy("file").count().orderBy("file").collect() if states is None else None
    if sizes is None:
        times: dict[str, int] = {}
        for r in rows:
            times[r["file"]] = times.get(r["file"], 0) + 1
        sizes = sorted(times.items())
    bases, total = [], 0
    for file, n in sizes:
        bases.append((file, total))
        total += n
    listing = spark.createDataFrame(bases, "file string, base bigint")
    every = whole.unionByName(stitched).join(F.broadcast(listing) if len(bases) <= MOST_SENT else listing, "file")
    return every.select("file", (F.col("place") + F.col("base") * F.lit(ROWS_PER_SPLIT)).alias("place"), (F.col("place") == 0).alias("header"), ended.alias("record"))
