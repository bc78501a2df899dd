import random
import struct

import numpy as np
from pyspark.sql import functions as F

from chromaframe.functions import header
from chromaframe.sources import formats

FORMS = {"i": "i", "u": "I", "f": "f", "d": "d"}


def block(attributes, end=b"\0"):
    return b"\x76\x2f\x31\x01" + struct.pack("<I", 2) + b"".join(n.encode() + b"\0" + t.encode() + b"\0" + struct.pack("<I", len(v)) + v for n, t, v in attributes) + end


def plain(data):
    """Attributes by a cursor over the bytes, and the error that ends them."""
    if data is None or data[:4] != b"\x76\x2f\x31\x01" or len(data) <= 8:
        return [], "no header"
    at, out = 8, []
    while True:
        name_end = data.find(b"\0", at)
        if name_end == at:
            return out, None
        type_end = data.find(b"\0", name_end + 1) if name_end >= 0 else -1
        if type_end < 0 or type_end + 5 > len(data):
            return out, "the header ends early"
        (size,) = struct.unpack_from("<I", data, type_end + 1)
        name, kind = data[at:name_end].decode(errors="replace"), data[name_end + 1 : type_end].decode(errors="replace")
        if type_end + 5 + size > len(data):
            return out, f"no {size} bytes for {name}"
        out.append((name, kind, data[type_end + 5 : type_end + 5 + size]))
        at = type_end + 5 + size
        if len(out) > header.MOST_ATTRIBUTES:
            return out, f"more than {header.MOST_ATTRIBUTES} attributes"


def value(kind, raw):
    if kind in header.NUMBERS:
        letter, count = header.NUMBERS[kind]
        form = f"<{count}{FORMS[letter]}"
        return list(map(float, struct.unpack(form, raw))) if struct.calcsize(form) == len(raw) else "wrong"
    if kind in header.NAMED:
        names = header.NAMED[kind]
        return "wrong" if len(raw) != 1 else names[raw[0]] if raw[0] < len(names) else "invalid"
    if kind == "string":
        return raw.decode(errors="replace")
    return None


def test_walk_is_the_plain_one(spark):
    random.seed(2)
    pixels = np.random.default_rng(1).random((2, 3, 4))
    every = [(f"n{k}", kind, struct.pack(f"<{count}{FORMS[letter]}", *[random.choice([0, 1, 7]) for _ in range(count)])) for k, (kind, (letter, count)) in enumerate(header.NUMBERS.items())]
    every += [("c", "compression", b"\3"), ("o", "lineOrder", b"\x09"), ("t", "string", "grün".encode()), ("e", "string", b""), ("v", "v2f", b"1234"), ("e2", "envmap", b"\1\1"), ("p", "preview", bytes(9)), ("neg", "v3d", struct.pack("<3d", -1.5, 1e300, -0.0))]
    whole = block(every)
    data = [formats.encode_exr(pixels), whole, *(whole[:n] for n in range(0, len(whole), 41)), block([], b""), block([]), block([("a", "int", b"\1\0\0\0")] * 300), block(every, b"\0tail"), None, b"", b"\x76\x2f\x31\x01", b"no header at all"]
    rows = header.header_rows(spark.createDataFrame([(k, None if d is None else bytearray(d), 1) for k, d in enumerate(data)], "id int, d binary, name int"), "id", "d").collect()
    for k, d in enumerate(data):
        want, error = plain(d)
        got = sorted((r for r in rows if r.id == k and r.name is not None), key=lambda r: r.position)
        assert [(r.name, r.type, bytes(r.bytes)) for r in got] == want, k
        assert [r.error for r in rows if r.id == k and r.name is None] == ([error] if error else []), k
        for r in got:
            v = value(r.type, bytes(r.bytes))
            assert (r.error == f"not the size of {r.type}" and r.numbers is None and r.text is None) if v == "wrong" else r.type == "chlist" or (r.numbers if isinstance(v, list) else r.text) == v, (r, v)
    assert [r.text for r in rows if r.id == 0 and r.type == "chlist"] == ["A, B, G, R"]
    assert [r.numbers for r in rows if r.id == 0 and r.name == "dataWindow"] == [[0.0, 0.0, 2.0, 1.0]]


def test_a_header_is_walked_once(spark):
    rows = header.header_rows(spark.range(3).select("id", F.unhex(F.concat(F.lit("762F310102000000"), F.hex("id"))).alias("d")), "id", "d")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
