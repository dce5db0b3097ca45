import pytest

from lattica.llm import licenses

SCANNER = licenses.Scanner(licenses.TEMPLATES, short=licenses.references())


def found(text):
    return [(m[0], m[1]) for m in SCANNER.scan(text)]


@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "AGPL-3.0-notice", "LGPL-2.1-notice", "LGPL-3.0-notice", "GPL-2.0-notice", "GPL-3.0-notice"])
def test_whole_texts_are_told_apart(name):
    assert found(f"x y {licenses.TEMPLATES[name]} z") == [(name, 1.0)]


@pytest.mark.parametrize("name", ["MIT-permission", "MIT-warranty", "BSD-2-Clause-conditions", "BSD-3-Clause-conditions", "BSD-disclaimer", "ISC-warranty"])
def test_parts_alone(name):
    assert found(f"x y {licenses.TEMPLATES[name]} z") == [(name, 1.0)]


@pytest.mark.parametrize(
    "text, name",
    [("SPDX-License-Identifier: MIT", "MIT"), ("MIT License", "MIT"), ("This project uses the MIT license", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("under the BSD 3-Clause License", "BSD-3-Clause"), ("GNU Affero General Public License v3", "AGPL-3.0"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0")],
)
def test_short_references(text, name):
    assert found(text) == [(f"{name}-reference", 1.0)]


def test_no_references():
    for text in ("", None, "MIT", "submit license", "summit licensed", "a license of the university"):
        assert found(text) == []


def test_the_operator_uses_them(spark):
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT"), (2, "see the file")], "doc_id long, text string")
    assert [tuple(r) for r in licenses.scanned(docs).collect()] == [(1, "MIT-reference", 1.0, 0, 4, 4)]
