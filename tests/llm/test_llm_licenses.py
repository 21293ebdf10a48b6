import math
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatewire.llm import licenses


def words(text):
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())


def header(text):
    """The leading comment, or the first paragraph, line by line."""
    lines = text.split("\n")
    if lines and lines[0].startswith("#!"):
        first, lines = lines[0], lines[1:]
    else:
        first = ""
    while lines and not lines[0].strip():
        lines.pop(0)
    joined = "\n".join(lines).lstrip()
    for begin, end in (("/*", "*/"), ("<!--", "-->")):
        if joined.startswith(begin) and end in joined[len(begin) :]:
            return first + " " + joined[: joined.index(end, len(begin))]
    comment = lambda x: x.strip().startswith(("#", "//", "--", ";", "%", "*"))
    goes_on = comment if lines and comment(lines[0]) else lambda x: bool(x.strip())
    n = next((i for i, x in enumerate(lines) if not goes_on(x)), len(lines))
    return first + " " + " ".join(lines[:n])


def brute(rows):
    """Best template of any line, header or whole text, by plain dictionaries."""
    df = Counter(w for _, _, text in rows for w in set(words(text)))
    known = {w for texts in licenses.TEMPLATES.values() for t in texts for w in words(t)}
    idf = lambda w: math.log((len(rows) + 1) / ((df[w] if w in known else 1) + 1)) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(words(t)).items()}

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / size if size else 0.0

    templates = [(name, vector(t)) for name, texts in licenses.TEMPLATES.items() for t in texts]
    out = []
    for ident, path, text in rows:
        best = max((cosine(vector(line), t) for line in [*(text or "").split("\n"), header(text or ""), text or ""] for _, t in templates), default=0.0)
        out.append((ident, path, best if best >= licenses.THRESHOLD else 0.0))
    return out


def wrapped(text, before=""):
    return textwrap.fill(text, 70, initial_indent=before, subsequent_indent=before)


FILES = [
    (1, "repo/LICENSE", "The project\nReleased under the MIT License.\nmore words here"),
    (2, "repo/src/a.py", "# Licensed under the Apache License, Version 2.0.\n" + "import x as y and z\n" * 9),
    (3, "repo/src/b.py", "import this is the work of others under version"),
    (4, "repo/lib/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    (5, "repo/lib/deep/er/c.c", None),
    (6, "repo/lib/deep/other.c", ""),
    (7, "repo", "released"),
    (8, None, "Licensed under CC BY-NC 4.0."),
    (9, "other/x/y.c", "int main() { return 0; }"),
    (10, "notice/only", "Licensed under CC BY 4.0."),
    (11, "notice/z", "some words"),
    (12, "repo/lib/deep/z.c", "SPDX-License-Identifier: BSD-3-Clause\n" + "w " * 500),
    (13, "repository/q.c", "nothing"),
    (3, "repo/src/b.py", "import this is the work of others under version"),
    (14, "tie/LICENSE", "Released under the ISC License."),
    (15, "tie/LICENSE.md", "Released under the MIT License."),
    (16, "tie/f.c", "f"),
    (17, "mit/LICENSE", "Copyright (c) 2024 Some One\n\n" + wrapped(licenses.TEMPLATES["MIT"][-1][12:])),
    (18, "mit/a/b.c", "int a;"),
    (19, "bsd/COPYING", "Copyright 2020, The Authors\n\n" + wrapped(licenses.TEMPLATES["BSD-3-Clause"][-1][21:])),
    (20, "bsd/a.py", "print(1)"),
    (21, "gpl/a.c", "/*\n" + wrapped(licenses.TEMPLATES["GPL-3.0"][-1], " * ") + "\n */\n\n" + "int main(void) { return 0; }\n" * 400),
    (22, "gpl/a.sh", "#!/bin/sh\n#\n" + wrapped(licenses.TEMPLATES["Apache-2.0"][-1], "# ") + "\n\nset -e\n" + "echo several words\n" * 300),
    (23, "gpl2/COPYING", "\n  GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n" + "some other words of a long text\n" * 90),
    (24, "gpl2/x", "x"),
    (25, "html/a.html", "<!-- " + wrapped(licenses.TEMPLATES["MPL-2.0"][1]) + " -->\n<p>text</p>\n"),
    (26, "open/a.c", "/* never closed\n" + "word after word\n" * 50),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(*f, "x") for f in FILES], "doc_id long, path string, text string, license string")
    return licenses.scan(files, F.col("path")).collect()


def test_own_licences_are_those_of_brute_force(found):
    own = [(r["doc_id"], r["path"], r["score"] if r["origin"] == "own" else 0.0) for r in found]
    want = brute(FILES)
    for got, expected in zip(sorted(own, key=repr), sorted(want, key=repr)):
        assert got[:2] == expected[:2] and got[2] == pytest.approx(expected[2])


def test_nearest_directory_counts(found):
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in found}
    assert len(found) == len(FILES)
    assert got[1] == ("MIT", "own", None)
    assert got[2] == ("Apache-2.0", "own", None)
    assert got[3] == ("MIT", "inherited", "repo")
    assert got[5] == got[6] == ("GPL-3.0", "inherited", "repo/lib")
    assert got[7] == got[9] == got[13] == (None, "none", None)
    assert got[8] == ("CC-BY-NC-4.0", "own", None)
    assert got[11] == ("CC-BY-4.0", "inherited", "notice")
    assert got[12] == ("BSD-3-Clause", "own", None)
    assert got[16][1:] == ("inherited", "tie")


def test_whole_licences_and_wrapped_headers(found):
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in found}
    assert got[17] == ("MIT", "own", None) and got[18] == ("MIT", "inherited", "mit")
    assert got[19] == ("BSD-3-Clause", "own", None) and got[20] == ("BSD-3-Clause", "inherited", "bsd")
    assert got[21] == ("GPL-3.0", "own", None) and got[22] == ("Apache-2.0", "own", None)
    assert got[23] == ("GPL-2.0", "own", None) and got[24] == ("GPL-2.0", "inherited", "gpl2")
    assert got[25] == ("MPL-2.0", "own", None) and got[26] == (None, "none", None)


def test_odd_rows_and_empty_table(odd_docs, odd_rows, no_docs):
    got = licenses.scan(odd_docs, F.concat_ws("/", "source", "doc_id")).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in odd_rows)
    assert {r["origin"] for r in got} == {"none"}
    assert licenses.scan(no_docs, F.col("source")).count() == 0


def test_documents(documents):
    rows = [(r["doc_id"], None, r["text"]) for r in documents.collect()]
    got = {r["doc_id"]: r["score"] for r in licenses.scan(documents, F.lit(None).cast("string")).collect()}
    assert {i: pytest.approx(s) for i, _, s in brute(rows)} == got
