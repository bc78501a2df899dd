"""Vector graphics and focus as packets leave them: which commands an image bears, and which image is selected.

An image is there from the packet that creates or opens it to the one that closes it. A packet of vector graphics for
an image that is there adds its commands or puts them in place of all before; so do creating, opening and
loading again, without any commands. What an image bears is thus what its packets from the last of these have brought, in
order. Packets for an image that is not there have no effect, nor on focus.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packets import CLOSE, CREATE, OPEN, OPEN_V2, RELOAD, UPDATE, UPDATE_V2, UPDATE_V3, VECTOR
from .publish import use_state_store

_BEGINS, _GOES_ON = (CREATE, OPEN, OPEN_V2), (RELOAD, UPDATE, UPDATE_V2, UPDATE_V3, VECTOR)


def _marked(packets: DataFrame, image: str, order: str) -> DataFrame:
    """seq, image, whether a packet begins or ends an image, or empties it, and its commands."""
    op = F.col("op")
    overwrites = (op == VECTOR) & ~F.coalesce(F.col("append"), F.lit(False))
    return packets.where(F.col(order).isNotNull() & F.col(image).isNotNull() & op.isin(*_BEGINS, *_GOES_ON, CLOSE)).select(
        F.col(order).alias("seq"), F.col(image).alias("image"), op.alias("op"),
        op.isin(*_BEGINS).alias("begins"), (op == CLOSE).alias("ends"), (overwrites | (op == RELOAD)).alias("empties"),
        F.coalesce("grab_focus", F.lit(False)).alias("focus"), F.when(op == VECTOR, F.col("commands")).alias("commands"),
    )


def _latest(condition: Column) -> Column:
    return F.max(F.when(condition, F.col("seq")))


def drawn(packets: DataFrame, image: str = "image", order: str = "seq") -> DataFrame:
    """image, seq, position (from 0 in each packet) and command: what each image bears in the end, to be drawn in order of seq
    and position.

    packets are decoded ones (op, image, append, commands), with one seq each; those without image or seq have no effect. No image's
    packets are gathered: where its last stretch begins is an aggregate, and its packets are joined with that.
    """
    rows = _marked(packets, image, order)
    ends = rows.groupBy("image").agg(_latest(F.col("begins")).alias("begun"), _latest(F.col("ends")).alias("ended"), _latest(F.col("empties")).alias("emptied"))
    there = ends.where("begun is not null and (ended is null or ended < begun)").select("image", F.greatest("begun", "emptied").alias("since"))
    last = rows.where("commands is not null").join(there, "image").where("seq >= since")
    return last.select("image", "seq", F.posexplode("commands").alias("position", "command"))


def traced(packets: DataFrame, image: str = "image", order: str = "seq") -> DataFrame:
    """image, seq, exists and commands (how many the image bears) after each packet, in the order of its packets."""
    upto = Window.partitionBy("image").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _marked(packets, image, order)
    rows = rows.withColumn("begun", _latest(F.col("begins")).over(upto)).withColumn("ended", _latest(F.col("ends")).over(upto))
    rows = rows.withColumn("exists", F.col("begun").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("begun"))))
    since = F.greatest(F.col("begun"), _latest(F.col("empties")).over(upto))
    own = F.when(F.col("commands").isNotNull(), F.size("commands")).otherwise(0).cast("long")
    rows = rows.withColumn("since", since).withColumn("all", F.sum(own).over(upto)).withColumn("before", F.col("all") - own)
    # What had come before the stretch began is no part of it.
    first = F.max_by("before", F.when(F.col("seq") == F.col("since"), F.col("seq"))).over(upto)
    return rows.withColumn("cut", first).select("image", "seq", "exists", "focus", F.when(F.col("exists"), F.col("all") - F.col("cut")).otherwise(0).alias("commands"))


def focused(packets: DataFrame, by: list[str] | None = None, image: str = "image", order: str = "seq") -> DataFrame:
    """by and selected: the image of the last packet that asks for focus and whose image is there after it, of each group."""
    groups = [F.col(c).alias(f"by__{k}") for k, c in enumerate(by or [])]
    keyed = packets.where(F.col(image).isNotNull()).select("*", F.struct(*groups, F.col(image).alias("image__")).alias("key__"))
    rows = traced(keyed, "key__", order).where("exists and focus")
    named = rows.select(*[F.col(f"image.by__{k}").alias(c) for k, c in enumerate(by or [])], F.col("image.image__").alias("selected"), "seq")
    return named.groupBy(*(by or [])).agg(F.max_by("selected", "seq").alias("selected"))


def drawn_stream(packets: DataFrame, image: str = "image", order: str = "seq") -> DataFrame:
    """image, seq and commands of each image that packets of a batch have changed, after the batch: all that it bears, null once it
    is not there. Packets of one image must come in order over batches; in a batch they are ordered.

    Commands go through the state as text, an entry for each packet, as nested values are slow to pass to Python and back."""
    use_state_store(packets.sparkSession)
    rows = _marked(packets, image, order)
    kind = rows.schema["commands"].dataType
    text = F.to_json(F.col("commands").cast(_wide(kind)))
    mark = F.when(F.col("begins"), _BEGUN).when(F.col("ends"), _ENDED).when(F.col("empties"), _EMPTIED).otherwise(0)
    out = T.StructType([rows.schema["image"], T.StructField("seq", T.LongType()), T.StructField("text", T.StringType())])
    borne = rows.select("image", "seq", mark.alias("mark"), text.alias("text")).groupBy("image").transformWithState(_processor(), out, "Update", "none")
    return borne.select("image", "seq", F.from_json("text", _wide(kind)).cast(kind).alias("commands"))


#: What a packet does to an image, besides its commands.
_BEGUN, _ENDED, _EMPTIED = 1, 2, 3


def _wide(kind: T.DataType) -> T.DataType:
    """The type with doubles for floats, whose text is read back as the same number."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_wide(kind.elementType), kind.containsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _wide(f.dataType), f.nullable) for f in kind.fields])
    return T.DoubleType() if isinstance(kind, T.FloatType) else kind


def _processor():
    from pyspark.sql.streaming import StatefulProcessor

    class Draw(StatefulProcessor):
        def init(self, handle) -> None:
            #: Of an image that is there an empty text, and after it the commands of each packet.
            self.borne = handle.getListState("borne", "text string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            before = [text for (text,) in self.borne.get()]
            there, new, clear, last = bool(before), [], False, None
            for last, mark, text in sorted(((r.seq, r.mark, r.text) for r in rows), key=itemgetter(0)):
                there = mark == _BEGUN or (there and mark != _ENDED)
                if mark in (_BEGUN, _ENDED) or (there and mark == _EMPTIED):
                    new, clear = [], True
                if there and text is not None and text != "[]":
                    new.append(text)
            if clear and there:
                self.borne.put([("",), *[(text,) for text in new]])
            elif clear and before:
                self.borne.clear()
            elif new:
                self.borne.appendList([(text,) for text in new])
            all_ = new if clear else before[1:] + new
            yield Row(image=key[0], seq=last, text="[" + ",".join(text[1:-1] for text in all_) + "]" if there else None)

        def close(self) -> None:
            pass

    return Draw()
