import hashlib
import os
import struct
from collections import defaultdict

import numpy as np
import pytest
import zstandard

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest string, revisit string, `a.b` int"


def pages(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA).repartition(parts)


def rows():
    rng = np.random.default_rng(0)
    words = ["<p>", "</p>", "alpha", "beta", "gamma", "<div class='x'>", "é", "\n"]
    own = [(i, f"http://x.org/{i}?q=%20a b", " ".join(rng.choice(words, rng.integers(0, 600)))) for i in range(60)]
    big, small = "copy " * 300, "short copy"
    edge = "e" * 999
    return own + [
        (100, "u", big), (101, "u", big), (103, None, big), (None, "u", big), (103, "twice", big), (110, "u", small), (111, "u", small),
        (120, "é\r\nX-Page-Id: 7 ", None), (121, "", ""), (130, "u", edge), (131, "u", edge), (132, "u", edge + "e"), (133, "u", edge + "e"),
        (140, "u", "long " * 400_000), (None, None, None), (150, "u", "WARC/1.1\r\n\r\n\x00 " * 100), (151, "u", "é" * 500), (152, "u", "é" * 500),
    ]


def plain(data):
    same = defaultdict(list)
    for i, _, t in data:
        same[t or ""].append(-1 << 60 if i is None else i)
    out = []
    for t, ids in same.items():
        raw = t.encode()
        for n, i in enumerate(sorted(ids, reverse=True)):
            again = n > 0 and len(raw) >= 1000
            out.append((None if i == -1 << 60 else i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=repr)


def result(df):
    keep = df.where("record_type != 'warcinfo'").selectExpr(
        "cast(page_id as long) p", "payload_bytes", "payload_digest", "record_type", "cast(refers_to_page as long) r"
    )
    return sorted((tuple(r) for r in keep.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 20_000, warc.ARCHIVE_BYTES])
def test_round_trip(spark, tmp_path, size):
    data = rows()
    archives = warc.write(pages(spark, data), str(tmp_path / "t"), archive_bytes=size)
    assert result(warc.read(archives)) == result(warc.read(archives, payloads=False)) == plain(data)
    back = warc.read(archives).where("record_type = 'response'").collect()
    ids = {r.record_id: r for r in back}
    assert len(ids) == len(back)
    texts = {i: t for i, _, t in data if i is not None}
    for r in back:
        if r.page_id is not None:
            assert bytes(r.payload).decode() == (texts[int(r.page_id)] or "")
    for r in warc.read(archives).where("record_type = 'revisit'").collect():
        assert ids[r.refers_to].payload_digest == r.payload_digest and ids[r.refers_to].page_id == r.refers_to_page
    uris = {r.page_id: r.target_uri for r in back}
    assert uris["0"] == "http://x.org/0?q=%20a%20b" and uris["120"] == "%C3%A9%0D%0AX-Page-Id:%207%20" and uris["121"] == ""
    if size == 1:
        assert archives.count() == len(data)


def test_leading_dictionary_frame(spark, tmp_path):
    archives = warc.write(pages(spark, rows()), str(tmp_path / "t")).collect()
    for a in archives:
        content = bytes(a.content)
        magic, n = struct.unpack_from("<II", content)
        assert magic == 0x184D2A5D
        shared = zstandard.ZstdCompressionDict(content[8:8 + n])
        assert shared.dict_id() > 0
        frames = list(warc.frames(content))
        assert len(frames) == a.n_records + 1
        for at, raw in frames:  # every record can be read alone
            params = zstandard.get_frame_parameters(content[at:at + 32])
            assert params.dict_id == shared.dict_id() and params.content_size == len(raw) and params.has_checksum
            assert zstandard.ZstdDecompressor(dict_data=shared).decompressobj().decompress(content[at:]) == raw
            assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(raw)) for a in archives for _, raw in warc.frames(bytes(a.content)))
    assert plain > sum(len(a.content) - 8 - struct.unpack_from("<II", a.content)[1] for a in archives)


def test_other_dictionary_frames():
    samples = [f"record {i} of many records with the same words {i * 7}".encode() * 5 for i in range(200)]
    d = warc.build_dictionary(samples)
    assert d
    (_, n, raw, content), = warc.archives_of(iter(samples), "a", d)
    assert n == 200 and raw == sum(map(len, samples))
    body = content[8 + len(d):]
    squeezed = zstandard.ZstdCompressor().compress(d)
    for lead in (warc.leading_frame(d), warc.leading_frame(squeezed), warc.leading_frame(d) + struct.pack("<II", 0x184D2A50, 3) + b"abc"):
        assert [r for _, r in warc.frames(lead + body)][1:] == samples
    assert warc.build_dictionary([]) == warc.build_dictionary([b"x"] * 100) == b""
    (_, _, _, bare), = warc.archives_of(iter(samples[:3]), "a", b"")
    assert [r for _, r in warc.frames(bare)][1:] == samples[:3]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(content[:-5]))


def test_files(spark, tmp_path):
    data = rows()
    archives = warc.write(pages(spark, data), str(tmp_path / "t"), archive_bytes=30_000)
    warc.export(archives, str(tmp_path / "files"))
    names = sorted(os.listdir(tmp_path / "files"))
    assert names == sorted(r.archive for r in archives.select("archive").collect())
    assert result(warc.read(warc.read_files(spark, str(tmp_path / "files")))) == plain(data)


def test_empty_table_and_damage(spark, tmp_path):
    archives = warc.write(pages(spark, []), str(tmp_path / "t"))
    assert archives.count() == 0 and warc.read(archives).count() == 0
    row = {"revisit": False, "record_id": "0" * 32, "url": "u", "sha1": hashlib.sha1(b"abc").hexdigest(), "page_id": 1, "payload_bytes": 3, "payload": "abd"}
    with pytest.raises(ValueError):
        warc._page(warc.parse(warc.page_record(row)))
    with pytest.raises(ValueError):
        warc.parse(warc.page_record(row) + b"x")
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_text_ids(spark, tmp_path):
    df = spark.createDataFrame([(" a%20\n", "h" * 2000), ("b", "h" * 2000), ("", "x")], "page_id string, html string").selectExpr("*", "page_id as url")
    found = warc.read(warc.write(df, str(tmp_path / "t"))).where("record_type != 'warcinfo'").collect()
    assert {(r.page_id, r.refers_to_page) for r in found} == {(" a%20\n", "b"), ("b", None), ("", None)}
