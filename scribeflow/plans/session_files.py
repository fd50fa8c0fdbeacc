"""Sessions written as a file each by the tasks that hold them; the driver hears of tasks, not of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..sources.files import file_system

#: The name of a session without a key, as Spark's writers have it.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def write_sessions(lines: DataFrame, root: str) -> None:
    """Lines (session_key, text), dealt by session and sorted, as files ``deal=N/session_key=NAME/part-0.txt`` below ``root``.

    A file gets its name when it is whole; a task that is tried again puts the same in its place. Keys have to be fit
    for names of folders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        task = TaskContext.get()
        deal, own = f"{base}/deal={task.partitionId():05d}", f"_part-{task.taskAttemptId()}"
        now, out = None, None

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(f"{now}/{own}", f"{now}/part-0.txt")

        for batch in batches:
            keys, texts = (batch.column(c).to_pylist() for c in ("session_key", "text"))
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                place = f"{deal}/session_key={NO_KEY if keys[at] is None else keys[at]}"
                if place != now:
                    close()
                    fs.create_dir(place)
                    now, out = place, fs.open_output_stream(f"{place}/{own}")
                out.write("".join((t or "") + "\n" for t in texts[at:to]).encode())
                at = to
        close()
        yield pa.RecordBatch.from_pylist([], schema=pa.schema([("path", pa.string())]))

    lines.select("session_key", "text").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
