import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import common, media

from .conftest import collect

TEXTS = [None, "", "a", "x" * 192, "x" * 193, "é\n\t" * 1000, "same", "same", "same  ", "<b>&amp;</b>", " "]


def test_query_equals_brute_force(spark, documents):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "again")]
    out = collect(media.query(spark, documents(rows)))
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        image = media.encode_png(p)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(image), hashlib.sha256(image).hexdigest(), media.features(p)))
    keys = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted((tuple(r[k] for k in keys) for r in out), key=str) == sorted(want, key=str)


def test_empty_table(spark, documents):
    assert media.query(spark, documents([])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=1000))
def test_png_round_trip(data):
    padded = media.pad(data)
    assert padded[: len(data)] == data and len(padded) % media.WIDTH == 0 and padded
    assert media.decode_png(media.encode_png(padded)) == padded


def test_parsing_keeps_order_and_captions():
    html = '<p>one <b>two</b></p><script>no()</script><figure><img src="a"><img src="b" alt="old"><figcaption>cap &amp; x</figcaption></figure>three<img src="c" alt="alt"><video><source src="d"></video><img>'
    items = media.parse_html(html)
    assert [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [(0, "text", "one two", None), (1, "media", "a", "cap & x"), (2, "media", "b", "cap & x"), (3, "text", "three", None), (4, "media", "c", "alt"), (5, "media", "d", None)]
    assert media.parse_html(None) == [] and media.parse_html("") == []


def test_sequences_with_missing_and_repeated_references(spark):
    payloads = spark.createDataFrame([(1, bytearray(b"p"), "c"), (2, bytearray(b"p"), "c"), (3, None, None)], "id long, payload binary, caption string")
    stored = common.materialise(media.store_media(payloads, common.new_dir(spark, "test-media")), "test-stored")
    table = media.media_table(stored)
    assert table.count() == 2
    digest = stored.where("id = 1").first()["digest"]
    html = f'<p>t</p><img src="{media.SCHEME}{digest}"><img src="http://x/y.png"><img src="{media.SCHEME}{digest}">'
    pages = spark.createDataFrame([(9, html), (8, None)], "id long, html string")
    (row,) = media.sequences_of(media.resolve(media.interleave(pages), table)).collect()
    assert row["id"] == 9
    assert [(i["position"], i["place"] is not None) for i in row["items"]] == [(0, False), (1, True), (2, False), (3, True)]
