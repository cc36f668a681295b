from __future__ import annotations

from tallyloom.llm import license_scan
from tallyloom.llm.license_scan import scan_licenses

DOCS = "doc_id long, text string, labels string, text_key int"


def _scan(table, *texts, **options):
    rows = scan_licenses(table(DOCS, *((n, t, "x", 1) for n, t in enumerate(texts))), **options).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in rows]


def test_phrases_and_odd_texts(table):
    got = _scan(table, "CC  by; cc-by. All rights\nRESERVED", None, "", "ccby all rights", "cc", "cc by", "cc by")
    assert got[0] == (7, 3, 0, 4, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert got[1] == got[2] == (0, 0, None, None, "", "", 0.0)
    assert got[3] == (3, 0, None, None, "", "", 0.0) and got[4][1] == 0
    assert got[5] == got[6] == (2, 1, 0, 0, "cc-by", "cc-by", 1.0)


def test_templates_wherever_they_stand(table):
    mit = license_scan.TEMPLATES["mit"].split()
    filler = [f"w{i}" for i in range(5000)]
    texts = [" ".join([*filler[:n], *mit[:13], *filler[n:]]) for n in (0, 11, 23, 24, 47, 4000)]
    for row in _scan(table, *texts, " ".join(mit[:10]), "of to any a is"):
        wanted = row[0] > 100
        assert (row[5] == "mit") == wanted and (row[6] > 0.8) == wanted


def test_against_brute_force(table):
    words = license_scan.TEMPLATES["gpl"].split() + ["x", "y"]
    texts = [" ".join(words[(n * k) % len(words)] for k in range(1, 9 + n)) for n in range(1, 30)]
    sets = {label: set(t.split()) for label, t in license_scan.TEMPLATES.items()}

    def labels(text):
        own, out = text.split(), {}
        for start in range(0, len(own), 24):
            block = set(own[start:start + 48])
            for label, template in sets.items():
                if 100 * len(block & template) >= 80 * len(template):
                    out[label] = max(out.get(label, 0), len(block & template) / len(template))
        return out

    for text, row in zip(texts, _scan(table, *texts), strict=True):
        found = labels(text)
        base = {x for x in row[4].split(",") if x}
        assert row[5] == ",".join(sorted(set(found) | base))
        assert row[6] == (1.0 if base else max(found.values(), default=0.0))


def test_empty_tables(table):
    assert _scan(table) == []
    assert _scan(table, "mit cc by", templates={})[0][5] == "cc-by"


def test_siblings_are_told_apart(table):
    texts = {"This work is licensed under the GNU General Public License.": "gpl", "This program is licensed under the GNU Affero General Public License": "agpl,gpl",
             "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa", "Licensed under CC BY 4.0": "cc-by",
             "Released under the MIT License.": "mit", "under the License mit der": "", "BSD 3-Clause License": "bsd", "Mozilla Public License 2.0": "mpl"}
    filler = "w " * 100
    rows = _scan(table, *(f"{filler}{t} {filler}" for t in texts), templates=license_scan.NOTICES, telling=license_scan.TELLING)
    assert [r[5] for r in rows] == list(texts.values())


def test_a_template_longer_than_the_least_block_is_found_wherever_it_stands(table):
    template = " ".join(f"t{n}" for n in range(60))
    filler = [f"w{n}" for n in range(400)]
    texts = [" ".join([*filler[:n], template, *filler[n:]]) for n in (0, 17, 59, 60, 119, 300)]
    rows = _scan(table, *texts, templates={"long": template}, percent=100)
    assert [(r[5], r[6]) for r in rows] == [("long", 1.0)] * len(texts)
