from strandline.llm import licenses as op

SCHEMA = "doc_id long, text string, license string, start string, saved int"


def test_hits(spark):
    mit = op.TEMPLATES["MIT"][1]
    rows = [
        (1, "Prose here.\nReleased under the MIT License.\nMore prose."),
        (2, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."),
        (3, "head\n" + mit.replace("any person", "every person").replace(". ", ".\n") + "\ntail of the text"),
        (4, "The license of the driver was lost; permission to travel was not given."),
        (5, "This work is licensed under the GNU General Public License, version 4."),
        (6, None), (7, ""), (None, "Licensed under the Apache License, Version 2.0."), (1, "RELEASED under the MIT license"),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((r["doc_id"] or 0, r["start"], r["license"], r["n_differences"]) for r in op.license_hits(docs).collect())
    assert got == [(0, 0, "Apache-2.0", 0), (1, 0, "MIT", 0), (1, 12, "MIT", 0), (2, 0, "CC-BY-NC-4.0", 0), (2, 29, "GPL-3.0", 0), (3, 5, "MIT", 2)]
    assert op.license_hits(docs.where("false")).collect() == []


def test_every_template_finds_itself():
    for name, texts in op.TEMPLATES.items():
        for t in texts:
            assert [h[0] for h in op.scan("before\n" + t + "\nafter it")] == [name], t


def test_differences():
    assert op.differences("a b c d".split(), "a x c".split()) == ["-b", "+x", "-d"]


def test_licenses_anywhere_in_a_line():
    names = lambda text: [h[0] for h in op.scan(text)]
    line = "Copyright Example. Released under the MIT License. See the file."
    (name, start, length, _, found), = op.scan(line)
    assert (name, line[start : start + length], found) == ("MIT", "Released under the MIT License.", [])
    assert names("Code: licensed under the Apache License, Version 2.0. Texts: licensed under CC BY 4.0. Rest: MIT.") == ["Apache-2.0", "CC-BY-4.0"]
    prose = " ".join(f"word{i} of the prose" for i in range(300))
    for template, name in ((op.TEMPLATES["MIT"][1], "MIT"), (op.TEMPLATES["GPL-3.0"][1], "GPL-3.0"), (op.TEMPLATES["BSD-3-Clause"][1], "BSD-3-Clause")):
        for changed in (template, template.replace(" the ", " that ", 1), template.replace(" of ", " of all ", 1)):
            text = f"{prose} {changed} {prose} {changed}"
            hits = op.scan(text)
            assert [h[0] for h in hits] == [name, name]
            assert [text[s : s + n] for _, s, n, _, _ in hits] == [changed, changed]


def test_neighbouring_licenses_are_told_apart():
    names = lambda text: [h[0] for h in op.scan(text)]
    assert names("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.") == []
    assert names("Released under the License.") == [] == names("This work is licensed under the GNU Affero General Public License, version 3.")
    listed = op._BSD.replace("met: Red", "met:\n\n1. Red").replace("disclaimer. Red", "disclaimer.\n2. Red")
    assert names(listed) == []  # both BSD licenses begin so
    assert names(f"{listed}\n\n{op._AS_IS}") == ["BSD-2-Clause"]
    assert names(listed + op.TEMPLATES["BSD-3-Clause"][1].removeprefix(op._BSD).replace(" Neither", "\n3. Neither") + "\n" + op._AS_IS) == ["BSD-3-Clause"]
