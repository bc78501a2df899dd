import struct
import xml.etree.ElementTree as ET
from io import StringIO

from pyspark.sql import functions as F

from chromaframe.functions import gainmap, rdf


def record(n, common, flags=0, denominator=100, version=0, front=b""):
    values = [3, 250, *[v for c in range(n) for v in (-50 - c, 150 + c, 100, 2 + c, -4)]]
    signs = "II" + "iiIii" * n
    head = struct.pack(">HHB", version, 1, flags | (gainmap.COMMON_DENOMINATOR if common else 0) | (gainmap.THREE_CHANNELS if n == 3 else 0))
    if common:
        return front + head + struct.pack(">I", denominator) + struct.pack(">" + signs, *values)
    return front + head + b"".join(struct.pack(f">{s}I", v, denominator) for s, v in zip(signs, values, strict=True))


def test_records(spark):
    whole = [record(n, common, flags) for n in (1, 3) for common in (True, False) for flags in (0, gainmap.BACKWARD, gainmap.BASE_COLOURS)]
    assert len(record(1, False)) == 61 and len(record(3, False)) == 141
    odd = [record(1, False, front=b"\0"), record(3, False, front=b"\0"), record(1, True, denominator=0), record(1, True, version=1), None, b"", b"\0\0"]
    cut = [record(3, True)[:-1], record(1, False)[:-1]]
    rows = spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, d in enumerate([*whole, *odd, *cut])], "k int, d binary")
    got = [r.g for r in rows.select("k", gainmap.iso_gain_map(F.col("d")).alias("g")).orderBy("k").collect()]
    for k, g in enumerate(got[:14]):
        n = 1 if k < 6 or k == 12 else 3
        flags = (0, gainmap.BACKWARD, gainmap.BASE_COLOURS)[k % 3] if k < 12 else 0
        ends, offsets = [0.03, 2.5], [[(2 + c) / 100 for c in range(n)] * (3 // n), [-0.04] * 3]
        if flags == gainmap.BACKWARD:
            ends.reverse()
            offsets.reverse()
        assert g.error is None and g.version == "ISO 21496-1 v0 / v1" and g.base_colours == (flags == gainmap.BASE_COLOURS)
        assert [g.base_headroom, g.alternate_headroom] == ends and [g.base_offset, g.alternate_offset] == offsets
        assert g.gain_min == [(-50 - c) / 100 for c in range(n)] * (3 // n) and g.gain_max == [(150 + c) / 100 for c in range(n)] * (3 // n) and g.gamma == [1.0] * 3
    assert got[14].base_headroom is None and got[14].gain_min == [None] * 3 and got[14].error is None
    assert [g.error for g in got[15:]] == ["version 1", "not enough data", "not enough data", "not enough data", "not enough data", "not enough data"]
    assert all(g.gamma is None and g.version is None for g in got[15:])


def test_a_record_is_read_once(spark):
    rows = spark.range(3).select(F.hex("id").cast("binary").alias("d")).select(gainmap.iso_gain_map(F.col("d")).alias("g"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("conv(") < 20


HEAD = '<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:rdf="http://r" xmlns:dc="http://dc" xmlns:xmp="http://xmp" xmlns:st="http://st" xmlns:hdrgm="http://g" xmlns:tiff="http://t"><rdf:RDF>'
TAIL = "</rdf:RDF></x:xmpmeta>"
PACKETS = [
    '<rdf:Description rdf:about="" xmp:Rating="3" tiff:Orientation=\'6\'/>',
    '<rdf:Description xmp:A="1 &gt; 0"><dc:title>\n <rdf:Alt>\n <rdf:li xml:lang="x-default">One &amp; &lt;two&gt;</rdf:li><rdf:li xml:lang="de">Zwei</rdf:li></rdf:Alt></dc:title><dc:empty/><dc:blank> </dc:blank></rdf:Description>',
    '<rdf:Description><xmp:From rdf:parseType="Resource"><st:id>7</st:id><st:list><rdf:Seq><rdf:li rdf:parseType="Resource"><st:a>1</st:a><st:b>2</st:b></rdf:li><rdf:li><rdf:Description st:a="3" st:b=""/></rdf:li></rdf:Seq></st:list></xmp:From><xmp:Link rdf:resource="http://x/?a=b"/><xmp:S st:a="4" st:b="5"/></rdf:Description>',
    '<rdf:Description xmp:Rating="1"/><rdf:Description xmp:Rating="2"><dc:x>a</dc:x></rdf:Description><!-- <dc:y>no</dc:y> -->',
]


def plain(xml):
    """Properties of a packet by a real parser, walking down."""
    prefixes, root = {}, None
    for event, value in ET.iterparse(StringIO(xml), ["start-ns", "start"]):
        if event == "start-ns":
            prefixes[value[1]] = value[0]
        elif root is None:
            root = value
    prefixes["http://www.w3.org/XML/1998/namespace"] = "xml"

    def name(tag):
        space, _, local = tag[1:].partition("}")
        return f"{prefixes[space]}:{local}"

    out = {}

    def put(path, value):
        if value:
            out.setdefault(path, None)
            out[path] = value

    def walk(node, path, items):
        own = name(node.tag)
        if own not in rdf.CONTAINERS:
            if own == "rdf:li":
                items[0] += 1
                path = f"{path}[{items[0]}]"
            else:
                path = f"{path}/{own}" if path else own
        for a, v in node.attrib.items():
            a = name(a)
            if a == "xml:lang":
                put(f"{path}/?xml:lang", v)
            elif a == "rdf:resource":
                put(path, v)
            elif not a.startswith("rdf:"):
                put(f"{path}/{a}" if path else a, v)
        if own not in rdf.CONTAINERS and (node.text or "").strip():
            put(path, node.text)
        inner = [0]
        for child in node:
            walk(child, path, inner)

    walk(root, "", [0])
    return list(out.items())


def test_leaves_are_the_parsers(spark):
    whole = [HEAD + p + TAIL for p in PACKETS]
    broken = [None, "", "no markup", HEAD + TAIL, HEAD + "<rdf:Description xmp:A='1'>" + TAIL, HEAD + PACKETS[0] + "</rdf:RDF>", "</a>"]
    rows = rdf.leaf_rows(spark.createDataFrame(list(enumerate([*whole, *broken])), "id int, xml string"), "id", "xml").collect()
    for k, xml in enumerate(whole):
        assert [(r.property, r.value) for r in sorted((r for r in rows if r.id == k), key=lambda r: r.ord)] == plain(xml)
    errors = {r.id: r.error for r in rows if r.error}
    assert sorted(errors) == list(range(4, 11)) and [r.property for r in rows if r.error] == [None] * 7


def test_tree_orientation_and_gain_map(spark):
    gain = [
        'hdrgm:Version="1" hdrgm:GainMapMax="2" hdrgm:HDRCapacityMax="3.5" hdrgm:HDRCapacityMin="4" hdrgm:Gamma="0" hdrgm:OffsetSDR="-1"',
        'hdrgm:Version="1" hdrgm:GainMapMin="1, 2,3" hdrgm:HDRCapacityMax="3" hdrgm:BaseRendition="HDR"><hdrgm:GainMapMax><rdf:Seq><rdf:li>0</rdf:li><rdf:li>5</rdf:li><rdf:li>6</rdf:li></rdf:Seq></hdrgm:GainMapMax></rdf:Description',
        'hdrgm:Version="1" hdrgm:GainMapMax="1,2" hdrgm:HDRCapacityMax="3"', 'hdrgm:Version="1" hdrgm:HDRCapacityMax="3"', 'hdrgm:GainMapMax="1"',
    ]
    packets = [HEAD + f"<rdf:Description {g}{'' if 'Seq' in g else '/'}>" + TAIL for g in gain] + [HEAD + PACKETS[0] + TAIL]
    leaves = rdf.leaf_rows(spark.createDataFrame(list(enumerate(packets)), "id int, xml string"), "id", "xml")
    maps = {r.id: r.gain_map for r in gainmap.property_gain_map(leaves, "id").collect()}
    assert set(maps) == {0, 1, 2, 3}
    assert (maps[0].gain_max, maps[0].base_headroom, maps[0].alternate_headroom, maps[0].gamma, maps[0].base_offset, maps[0].alternate_offset) == ([2.0] * 3, 4.0, 4.0, [0.001] * 3, [0.0] * 3, [1 / 64] * 3)
    assert (maps[1].gain_min, maps[1].gain_max, maps[1].base_headroom, maps[1].alternate_headroom) == ([1.0, 2.0, 3.0], [1.0, 5.0, 6.0], 3.0, 0.0)
    assert (maps[2].error, maps[3].error) == ("GainMapMax is not one number or three", "GainMapMax is required")
    assert {r.id: r.orientation for r in rdf.orientation_rows(leaves, "id").collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 6}
    tree = [(r.path, r.depth, r.name, r.value) for r in rdf.tree_rows(leaves, "id").where("id = 1").orderBy("ord").collect()]
    assert tree[-1] == ("XMP/hdrgm:", 2, "GainMapMax[3]", "6")
