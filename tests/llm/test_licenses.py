"""Known licence texts keep their digest however their lines are wrapped."""

import re
import textwrap
from pathlib import Path

import pytest

from axonframe.llm import licenses

COMMON = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def wrapped(text, width):
    """Paragraphs wrapped anew; one with a notice line stays as it is."""
    parts = re.split(r"\n[ \t]*\n", text)
    return "\n\n".join(p if re.search(licenses.NOTICE, p.lower()) else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in parts)


@pytest.mark.parametrize("width", range(20, 131, 5))
def test_wrapping_keeps_the_digest(width):
    for name, text in licenses.TEXTS:
        assert licenses.known()[licenses.digest_of(wrapped(text, width))] == name
    for file, name in FILES.items():
        if width >= 40 and (COMMON / file).exists():  # below, a notice inside a paragraph comes to a line's start
            assert licenses.known()[licenses.digest_of(wrapped((COMMON / file).read_text(), width))] == name


def test_a_wrapped_isc_text_is_known(spark):
    isc = dict(licenses.TEXTS)["ISC"]
    usual = isc.replace("\n", " ").replace("  ", "\n\n").replace("above copyright", "above\ncopyright").replace("<owner>", "Some One")
    rows = [(0, isc), (1, usual), (2, usual.replace("Copyright (c) <year>", "Copyright 2009-2011,"))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert "\ncopyright notice and" in usual and [r["license"] for r in got] == ["ISC"] * 3
