"""A streaming source that follows a log kept as Parquet, partition by partition."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "part int, off long, k long, value double"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, path: str, part: int, start: int, end: int):
        self.path, self.part, self.start, self.end = path, part, start, end


class LogTail(DataSource):
    """``spark.readStream.format("logtail").option("path", ...)``: records after the last offset seen.

    The path (local, or a URI that Arrow's file systems know) holds Parquet files with part, off, k and
    value. Ends of the log come from the files' footers. Offsets are a number for each partition;
    a restart goes on from the checkpoint, and each range of offsets is one task.
    """

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):  # noqa: N802 - the interface's name
        return LogTailReader(self.options)


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.step = int(options.get("rangerows", 1 << 20))
        self.seen: set[str] = set()
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = _store(self.path)
        for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if not f.path.endswith(".parquet") or f.path in self.seen:
                continue
            self.seen.add(f.path)
            with store.open_input_file(f.path) as at:
                file = pq.ParquetFile(at)
                place = {file.metadata.schema.column(i).name: i for i in range(file.metadata.num_columns)}
                for g in range(file.num_row_groups):
                    p, o = (file.metadata.row_group(g).column(place[c]).statistics for c in ("part", "off"))
                    if p and o and p.has_min_max and o.has_min_max and p.min == p.max:
                        rows = [(p.min, o.max)]
                    else:  # several partitions in one row group
                        t = file.read_row_group(g, columns=["part", "off"]).group_by("part").aggregate([("off", "max")])
                        rows = zip(t["part"].to_pylist(), t["off_max"].to_pylist(), strict=True)
                    for part, off in rows:
                        self.ends[str(int(part))] = max(self.ends.get(str(int(part)), 0), int(off) + 1)
        return dict(self.ends)

    def partitions(self, start: dict, end: dict):
        return [
            Range(self.path, int(p), a, min(int(e), a + self.step))
            for p, e in sorted(end.items())
            for a in range(int(start.get(p, 0)), int(e), self.step)
        ]

    def read(self, r: Range):
        import pyarrow.dataset as ds

        want = (ds.field("part") == r.part) & (ds.field("off") >= r.start) & (ds.field("off") < r.end)
        store, root = _store(self.path)
        t = ds.dataset(root, filesystem=store, format="parquet").to_table(columns=["part", "off", "k", "value"], filter=want).sort_by("off")
        yield from t.to_batches()
