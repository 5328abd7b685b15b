"""Version lines of the archive format inside pages."""

from __future__ import annotations

from creatorlens.llm import warc


def test_consecutive_version_lines_in_html(spark):
    line = warc.VERSION.decode()
    rows = [(1, "u", "a" + line * 2 + "b"), (2, "u", line * 3), (3, "u", "plain"), (4, "u", "x" + line * 2)]
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {i: (len(h), warc.payload_digest(h.encode())) for i, _, h in rows}
