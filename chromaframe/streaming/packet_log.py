"""An append-only log of packets in a shared folder, as a sink and as a source of batches and streams.

A socket is read by one process and cannot be read again; that process appends what it receives to a log, and the log is
what Spark reads. A segment is a file of framed packets (see packets.frame) that is complete when it gets its name, of the
number of its first packet and their count. An offset is the number of the next packet, so a stream that
starts again asks for the same packets, and those of a batch are the same whenever it is run.

A log has one writer at a time: a receiving process, or a query with the sink.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from .packets import Malformed, frame, framed_chunks, split_frames

SCHEMA = "seq long, payload binary"
_SEGMENT = re.compile(r"([0-9]{20})-([0-9]{10})\.packets")
#: Bytes of a segment when more packets follow at once, and bytes of segments that share a task.
SEGMENT_BYTES = TASK_BYTES = 64 << 20
#: Packets in one record batch.
BATCH_PACKETS = 4096


@dataclass(frozen=True, order=True)
class Segment:
    first: int
    count: int
    path: str
    size: int

    @property
    def end(self) -> int:
        return self.first + self.count


class PacketLog:
    """The segments of a folder, which is a URI of a store that Arrow's file systems reach, or a path."""

    def __init__(self, folder: str) -> None:
        self.system, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))

    def segments(self) -> list[Segment]:
        found = self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        named = [(m, i) for i in found if (m := _SEGMENT.fullmatch(i.base_name))]
        return sorted(Segment(int(m[1]), int(m[2]), i.path, i.size) for m, i in named)

    def begin(self) -> int:
        return min((s.first for s in self.segments()), default=0)

    def end(self) -> int:
        return max((s.end for s in self.segments()), default=0)

    def stage(self, payloads: Iterable[bytes]) -> tuple[str, int]:
        """A file of packets that has no place in the log yet, and their count."""
        path, count = f"{self.folder}/_staged/{uuid.uuid4().hex}", 0
        self.system.create_dir(f"{self.folder}/_staged", recursive=True)
        with self.system.open_output_stream(path) as out:
            for payload in payloads:
                out.write(frame(payload))
                count += 1
        return path, count

    def publish(self, staged: Iterable[tuple[str, int]]) -> int:
        """Gives staged files their places, one after another; the log's new end."""
        at = self.end()
        for path, count in staged:
            if count:
                self.system.move(path, f"{self.folder}/{at:020d}-{count:010d}.packets")
            else:
                self.system.delete_file(path)
            at += count
        return at

    def append(self, payloads: Iterable[bytes]) -> int:
        return self.publish([self.stage(payloads)])

    def trim(self, before: int) -> None:
        """Deletes segments that hold only packets before a number; a stream that still needs them then ends with an error."""
        for s in self.segments():
            if s.end <= before:
                self.system.delete_file(s.path)

    def read(self, segment: Segment, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """The packets of a segment from one number up to another, with their numbers."""
        seq, rest = segment.first, b""
        with self.system.open_input_stream(segment.path) as source:
            while seq < min(end, segment.end):
                chunk = source.read(1 << 20)
                if not chunk:
                    raise Malformed(f"{segment.path} ends after {seq - segment.first} of {segment.count} packets")
                done, rest = split_frames(rest + chunk)
                for payload in done:
                    if start <= seq < end:
                        yield seq, payload
                    seq += 1


def receive(chunks: Iterable[bytes], log: PacketLog, segment_bytes: int = SEGMENT_BYTES) -> int:
    """Appends the packets of a connection's bytes as they come in, in segments of about so many bytes; the log's new end.

    For a socket: receive(iter(lambda: connection.recv(1 << 20), b""), log). What follows the last whole packet is lost with the connection.
    """
    held, size = [], 0
    for payload in framed_chunks(iter(chunks)):
        held.append(payload)
        size += len(payload) + 4
        if size >= segment_bytes:
            log.append(held)
            held, size = [], 0
    return log.append(held) if held else log.end()


@dataclass
class Range(D.InputPartition):
    start: int
    end: int
    segments: tuple[Segment, ...]


class _Reading:
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))

    def planned(self, start: int, end: int) -> list[Range]:
        """Packets from one number up to another, by tasks; it is an error if any of them is not in the log any more."""
        out, own, held, at = [], [], 0, start
        for s in PacketLog(self.folder).segments():
            if s.end <= start or s.first >= end:
                continue
            if s.first > at:
                break
            at = s.end
            if own and held + s.size > self.task_bytes:
                out.append(Range(start, end, tuple(own)))
                own, held = [], 0
            own.append(s)
            held += s.size
        if at < end:
            raise ValueError(f"the log {self.folder} has no packet {at}")
        return [*out, Range(start, end, tuple(own))] if own else out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        log, rows = PacketLog(self.folder), []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["seq", "payload"])

        for segment in partition.segments:
            for row in log.read(segment, partition.start, partition.end):
                rows.append(row)
                if len(rows) == BATCH_PACKETS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class PacketReader(_Reading, D.DataSourceReader):
    def partitions(self) -> list[Range]:
        log = PacketLog(self.folder)
        return self.planned(log.begin(), log.end())


class PacketStreamReader(_Reading, D.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": PacketLog(self.folder).begin()}

    def latestOffset(self) -> dict:
        return {"next": PacketLog(self.folder).end()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.planned(start["next"], end["next"])


@dataclass
class Staged(D.WriterCommitMessage):
    path: str
    count: int


class PacketWriter(D.DataSourceWriter):
    """Each task stages its packets; the commit gives them their places in the order of tasks, so a failed query adds none."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator) -> Staged:
        return Staged(*PacketLog(self.folder).stage(bytes(row["payload"]) for row in iterator))

    def commit(self, messages) -> None:
        PacketLog(self.folder).publish((m.path, m.count) for m in messages if m is not None)

    def abort(self, messages) -> None:
        log = PacketLog(self.folder)
        for m in messages:
            if m is not None:
                log.system.delete_file(m.path)


class Packets(D.DataSource):
    """Format "packetlog": seq and payload of a log's packets. The sink takes a column payload.

    Option taskBytes: segments up to so many bytes share a task.
    """

    @classmethod
    def name(cls) -> str:
        return "packetlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PacketReader:
        return PacketReader(self.options)

    def streamReader(self, schema) -> PacketStreamReader:
        return PacketStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> PacketWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return PacketWriter(self.options["path"])


def write_packets(packets: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """Append payloads to a log; with order, in that order over all tasks."""
    packets.sparkSession.dataSource.register(Packets)
    dealt = packets.repartitionByRange(*order).sortWithinPartitions(*order) if order else packets
    dealt.select("payload").write.format("packetlog").mode("append").save(folder)


def read_packets(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Packets)
    return spark.read.format("packetlog").load(folder)


def stream_packets(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Packets)
    return spark.readStream.format("packetlog").load(folder)
