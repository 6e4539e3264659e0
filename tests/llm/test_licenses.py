import re

from helpers import ODD, SF, documents

from ridgeline.llm import licenses


def found(spark, texts, **parameters):
    rows = licenses.recognise(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), **parameters).collect()
    return {r.doc_id: r for r in rows}


def full(prefix):
    return "\n".join(s for n, s in licenses.SENTENCES if n.startswith(prefix) and "Short" not in n)


def test_sequences_and_order(spark):
    rows = found(spark, [
        "Some words\nLicensed under the Apache License, Version 2.0.\nmore",
        "x.\n" + full("Apache") + " y", full("MIT"), full("BSD"), "some\nRELEASED UNDER the\tMIT  licence.", "This program is free", full("GPL3Later") + "\n" + full("GPLNo") + " " + full("GPLSee"),
        full("Apache").replace("\n", "\n\n").replace(" ", "\n "), "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.",
        full("GPLSee"),
    ])
    want = ["Apache-2.0", "Apache-2.0", "MIT", "BSD-3-Clause", "", "", "GPL-3.0-or-later", "Apache-2.0", "MIT,CC-BY-NC-4.0", ""]
    assert [rows[i].licences for i in range(len(want))] == want
    assert rows[1].n_unused == 0 and rows[1].n_known >= 5 and rows[9].n_unused == 1
    assert rows[0].sequence == "<?><ApacheShort><?>"


def test_all_known_sentences_have_a_keyword():
    for name, sentence in licenses.SENTENCES:
        first = licenses.normal(licenses.pieces_of(sentence)[0])
        assert any(k in licenses.normal(sentence) for k in licenses.KEYWORDS), name
        assert first


def test_every_rule_can_match(spark):
    by = dict(reversed(licenses.SENTENCES))
    rows = found(spark, ["\n".join(by[n] for n in sequence) for _, sequence in licenses.RULES])
    assert [rows[i].licences for i in range(len(licenses.RULES))] == [x for x, _ in licenses.RULES]


def test_odd_rows_and_empty_table(spark):
    rows = licenses.recognise(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r.licences == "" and r.n_known == 0 for r in rows)
    assert licenses.recognise(documents(spark, [])).collect() == []


def test_documents(spark):
    rows = {r.doc_id: r.licences for r in licenses.op1(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {d for d, x in rows.items() if "MIT" in x} == {d for d, t in docs.items() if "Released under the MIT License." in t.split("\n")}


def test_every_licence_line_of_documents(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "All rights reserved.": "NONE-GRANTED",
    }
    sf = SF.replace("0.001", "0.01")
    rows = {r.doc_id: set(filter(None, r.licences.split(","))) for r in licenses.op1(spark, sf).collect()}
    docs = {r.doc_id: (r.text or "").split("\n") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    planted = {x for text in docs.values() for x in text if re.match("(Licensed|Released|This work is licensed) under |All rights reserved", x) and len(x) < 100}
    assert planted == set(lines)
    assert rows == {d: {lines[x] for x in text if x in lines} for d, text in docs.items()}


def test_numbered_and_spaced_texts(spark):
    by = dict(licenses.SENTENCES)
    clauses = [by[n] for n in ("BSDSource", "BSDBinary", "BSDEndorse")]
    owner = "Copyright (c) 2020, Some Owner\nAll rights reserved.\n\n"
    bsd = lambda k, head="", mark="{}. ": head + by["BSDGrant"] + "\n\n" + "\n\n".join(mark.format(i) + c.replace(", this", ", this\n   ") for i, c in enumerate(clauses[:k], 1))
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
        'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\n'
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n"
    )
    end = '\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "AS IS".'
    cases = [
        (bsd(3), "BSD-3-Clause"), (bsd(2), "BSD-2-Clause"), (bsd(1), "BSD-1-Clause"), (bsd(3, owner) + end, "BSD-3-Clause"), (bsd(2, owner), "BSD-2-Clause"), (bsd(1, owner), "BSD-1-Clause"),
        (bsd(3, mark="* "), "BSD-3-Clause"), (bsd(2).replace("1. ", "a. ").replace("2. ", "b. "), "BSD-2-Clause"), (apache, "Apache-2.0"), ("Some code.\n\n" + apache + "\nimport x", "Apache-2.0"),
    ]
    rows = found(spark, [t for t, _ in cases] + [bsd(2).replace("1. ", "Another sentence. "), bsd(2).replace("1. ", "別の文です. ")])
    assert [(rows[i].licences, rows[i].n_unused) for i in range(len(cases))] == [(x, 0) for _, x in cases]
    assert rows[len(cases)].licences == rows[len(cases) + 1].licences == "" and rows[8].n_known == 6
