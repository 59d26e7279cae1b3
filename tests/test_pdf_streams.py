"""Streams of PDFs (SRC-11) whose last byte is a line break."""

import pytest

from millrace.sources.files import pdf, pdf_text

LINE = "Customer#000000998 (BUILDING)"  # its deflated stream ends with a carriage return


def test_deflated_streams_may_end_with_a_line_break():
    """Before, the carriage return was taken for part of the line end, and the stream was cut."""
    made = pdf(LINE)
    assert b"\r\nendstream" in made and pdf_text(made) == LINE
    for k in range(15000, 30000):
        line = f"Customer#{k:09d} (MACHINERY)"
        assert pdf_text(pdf(line)) == line


@pytest.mark.parametrize("size", [b"", b"/Length 9 0 R", b"/Length 3", b"/Length 99999"])
@pytest.mark.parametrize("line_end", [b"\n", b"\r\n"])
def test_lengths_that_are_missing_indirect_or_wrong(size, line_end):
    made = pdf(LINE)
    own = made[made.index(b"/Length") : made.index(b" >>")]
    assert pdf_text(made.replace(own, size).replace(b"\nendstream", line_end + b"endstream")) == LINE


def test_several_streams_and_plain_ones():
    plain = b"<< /Length 12 >>\nstream\nBT (a b) Tj \r\nendstream endobj "
    assert pdf_text(plain + pdf(LINE) + plain) == f"a b\n{LINE}\na b" and pdf_text(b"<< >> stream\n(x) Tj") == ""
