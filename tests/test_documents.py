"""Playlist lines as rows, and one nested document from sorted lines."""

import glob
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from concordat.operators import playlists
from concordat.plans import exports


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_lines_as_rows_equal_whole_texts(spark, block):
    rng = random.Random(block)
    kinds = ["#EXTM3U", "#EXTINF:12,A - B", "#EXTINF:x,no number", "#other", "", "   ", "/m/a.mp3", " /m/b - c.mp3 ", "#EXTINF:3.7, An – Other "]
    texts = [(f"f{k}", "\n".join(rng.choices(kinds, k=rng.randint(0, 40)))) for k in range(12)] + [("empty", ""), ("notes", "#EXTINF:1,a\n#EXTINF:2,b")]
    lines = [(f, n, line) for f, text in texts for n, line in enumerate(text.split("\n"))] + [("null", 0, None)]
    rng.shuffle(lines)
    whole = playlists.parse_m3u(spark.createDataFrame(texts, "file string, content string"))
    rows = playlists.parse_lines(spark.createDataFrame(lines, "file string, line_no long, line string"), block)
    assert rows.columns == whole.columns
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect()))


def test_one_nested_document(spark, tmp_path):
    collection = spark.createDataFrame(
        [(1, "A & B", 'Say "x" <y>', "MP3 File", 60, "file://localhost/a", 255, "high"), (2, "C\x01", "Ü\n2", None, None, "file://localhost/b", None, None), (10, "T", "Z", "MP3 File", 1, "l", 0, "")],
        "track_no long, artist string, title string, kind string, duration int, location string, stars int, energy string",
    )
    nodes = spark.createDataFrame(
        [
            ("folder", "", "", -1, -1, 3), ("folder", "b", "b", 0, -1, 2), ("folder", "a", "a", 999, -1, 1), ("folder", "b/c", "c", 999, -1, 1),
            ("playlist", "b/c", "deep", 999, 0, 2), ("playlist", "b", "Q&A", 0, 999, 1), ("playlist", "", "top", -1, 0, 0), ("playlist", "a", "zz", 999, 5, 3),
        ],
        "kind string, folder string, name string, folder_index int, index int, n long",
    )
    files = spark.createDataFrame([("1", "b/c", "deep"), ("2", "b", "Q&A"), ("3", "", "top"), ("4", "a", "zz")], "file string, folder string, name string")
    entries = spark.createDataFrame([("1", 10, 2), ("1", 2, 9), ("2", 1, 1), ("4", 1, 3), ("4", 2, 2), ("4", 10, 11)], "file string, track_no long, pos int")
    document = exports.collection_document(collection, nodes, files, entries)
    assert "CartesianProduct" not in document._jdf.queryExecution().executedPlan().toString()
    exports.write_document(document.repartition(5), f"{tmp_path}/doc")
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{tmp_path}/doc/part-*")))
    root = ET.fromstring(text)

    tracks = root.find("COLLECTION")
    assert root.tag == "DJ_PLAYLISTS" and tracks.get("Entries") == "3"
    assert [(t.get("TrackID"), t.get("Artist"), t.get("Name"), t.get("Rating")) for t in tracks] == [("1", "A & B", 'Say "x" <y>', "255"), ("2", "C", "Ü\n2", None), ("10", "T", "Z", "0")]

    def tree(node):
        keys = [t.get("Key") for t in node.findall("TRACK")]
        return node.get("Name"), node.get("Count") or node.get("Entries"), keys or [tree(n) for n in node.findall("NODE")]

    (top,) = root.find("PLAYLISTS")
    assert tree(top) == ("ROOT", "1", [
        ("m3u", "3", [
            ("b", "2", [("c", "1", [("deep", "2", ["10", "2"])]), ("Q&A", "1", ["1"])]),
            ("a", "1", [("zz", "3", ["2", "1", "10"])]),
            ("top", "0", []),
        ]),
    ])


def test_a_document_without_folders_or_tracks(spark, tmp_path):
    none = lambda schema: spark.createDataFrame([], schema)
    document = exports.collection_document(
        none("track_no long, artist string, title string, kind string, duration int, location string, stars int, energy string"),
        none("kind string, folder string, name string, folder_index int, index int, n long"), none("file string, folder string, name string"), none("file string, track_no long, pos int"),
    )
    lines = [r["line"] for r in document.orderBy("section", "path").collect()]
    assert ET.fromstring("\n".join(lines)).find("COLLECTION").get("Entries") == "0"
    assert document.where(F.col("line").isNull()).isEmpty()
