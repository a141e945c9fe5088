"""Match files as a sink: path/genome1/genome2 for each pair of genomes, written by the tasks and put in place by one rename.

Rows (genome1, genome2, value) must come with each pair of genomes in one partition and in order; `genomes.write_matches` deals them so. A pair whose rows are marked `split` may come in
several partitions that follow each other: it is a folder path/genome1/genome2, to which each adds a part, a file of the same format. A task writes a file beside its place in a folder of the job's
own, closes it and moves it there, so a task that fails leaves no part of a file, and one that runs twice leaves the same file once. Only when all tasks are done does the folder replace
earlier output; a job that fails leaves earlier output as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

HEAD, END = "# AllAll of {} vs {};\nRefinedMatches(\n[", " ]):"  # fixed values of the format


def located(path: str) -> tuple[pa_fs.FileSystem, str]:
    return pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (pa_fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class MatchWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staged = f"{self.path}.staged-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        fs, root = located(self.staged)
        done, now, out, part, place = Written(), None, None, "", ""

        def close() -> None:
            if out is not None:
                out.write(f"{END}\n".encode())
                out.close()
                fs.move(part, f"{root}/{place}")
                done.files.append(place)

        for row in iterator:
            pair = (row["genome1"], row["genome2"])
            if pair != now:
                close()
                now, part = pair, f"{root}/{pair[0]}/.{pair[1]}-{uuid.uuid4().hex}"
                place = "/".join(pair) + (f"/part-{TaskContext.get().partitionId():06d}" if "split" in row and row["split"] else "")
                fs.create_dir(f"{root}/{place}".rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(part)
                out.write((HEAD.format(*pair) + row["value"]).encode())
            else:
                out.write(f",\n{row['value']}".encode())
        close()
        return done

    def commit(self, messages) -> None:
        files = [f for m in messages if m for f in m.files]
        if len(set(files)) != len(files):
            raise ValueError("a pair of genomes came in more than one partition")
        fs, root = located(self.staged)
        _, to = located(self.path)
        fs.create_dir(root, recursive=True)
        if fs.get_file_info(to).type != pa_fs.FileType.NotFound:
            fs.delete_dir(to)
        fs.create_dir(to.rpartition("/")[0], recursive=True)
        fs.move(root, to)

    def abort(self, messages) -> None:
        fs, root = located(self.staged)
        if fs.get_file_info(root).type != pa_fs.FileType.NotFound:
            fs.delete_dir(root)


class MatchSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "match_files"

    def schema(self) -> str:
        return "genome1 string, genome2 string, value string, split boolean"

    def writer(self, schema, overwrite: bool) -> MatchWriter:
        return MatchWriter(self.options["path"])
