import random
import re

import pytest

from inkwell.llm import license_scan as ls
from inkwell.llm import queries
from inkwell.llm.license_templates import NOTICES

SCHEMA = "doc_id long, text string, licences string, n_words int"


def base(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = []
    for phrase, label in ls.PHRASES.items():
        own = phrase.split()
        found += [(label, i) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), sorted(found)


def texts():
    rnd = random.Random(8)
    bits = ["gnu", "General", "PUBLIC", "license", "apache", "cc", "by", "mit", "x", "é", "İ", "-", "."]
    return [None, "", "..", "license", "Apache", "CC BY-NC", "cc by cc by", "éapache license", "apache licenseé", *(" ".join(rnd.choice(bits) for _ in range(30)) for _ in range(150)), "filler words " * 30_000 + "mit license"]


def scanned(spark, own):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(own)], SCHEMA)
    return {r.doc_id: r.licences for r in ls.scan(df).collect()}


def test_places_against_brute_force(spark):
    own = texts()
    got = scanned(spark, own)
    for i, t in enumerate(own):
        n, places = base(t)
        assert got[i].n_words == n
        assert sorted((p.label, p.word) for p in got[i].places) == places


def accepts(template, text):
    words = text.split()
    a = ls.compile_template("t", template)
    return a.longest(lambda i: words[i].encode(), 0, len(words)) == len(words)


def test_automata():
    t = "start [[of the [[whole]]]] work {{2}} made {{by | with {{1}} by}} hand"
    good = ["start work q made by hand", "start of the work q made by hand", "start of the whole work a b made by hand", "start work a made with x by hand"]
    bad = ["start", "start work made by hand", "start whole work made by hand", "start work a b c made by hand", "start work made hand", "start work made with by hand", "begin work made by hand"]
    assert all(accepts(t, x) for x in good) and not any(accepts(t, x) for x in bad)
    for wrong in ("a [[b", "a ]] b", "a {{b", "[[a]]", "{{3}} a"):
        with pytest.raises(ValueError):
            ls.compile_template("t", wrong)


def test_notices(spark):
    own = {
        "This work is licensed under the GNU General Public License, version 3.": {"gpl-notice"},
        "This work is licensed under the GNU Public License, version 3.": set(),
        "Licensed under the Apache License, Version 2.0.": {"apache-notice"},
        "Released under the MIT License.": {"mit-notice"},
        "Licensed under CC BY-NC 4.0.": {"cc-by-notice"},
        "Licensed under CC-BY 4.0": {"cc-by-notice"},
        "All rights reserved.": {"all-rights-reserved"},
        "Copyright (c) 2020 by Some Body. All rights reserved.": {"all-rights-reserved"},
        "All the rights reserved": set(),
    }
    got = scanned(spark, list(own))
    for i, (text, labels) in enumerate(own.items()):
        assert {m.label for m in got[i].matches} == labels, text
    assert [(m.first, m.end) for m in got[0].matches] == [(0, 12)]


MARK = re.compile(r"\[\[|\]\]|\{\{|\}\}|\|")


def filled(template, keep, name, rnd):
    """A text of a template: replaceable regions filled with names, optional ones kept or not."""
    tokens = re.findall(r"\[\[|\]\]|\{\{|\}\}|\||[^\s\[\]{}|]+|[\[\]]", template)

    def part(i, end):
        options, own = [], []
        while tokens[i] != end if i < len(tokens) else False:
            if tokens[i] in ("[[", "{{"):
                got, j = part(i + 1, "]]" if tokens[i] == "[[" else "}}")
                if tokens[i] == "{{" and len(got) == 1 and got[0].isdigit():
                    got = name[: int(got[0])]
                own += got if tokens[i] == "{{" or keep else []
                i = j
            elif tokens[i] == "|":
                options.append(own)
                own, i = [], i + 1
            else:
                own.append(tokens[i])
                i += 1
        options.append(own)
        return rnd.choice(options), i + 1

    return " ".join(part(0, None)[0])


def test_whole_texts(spark):
    """Texts with any names and years are accepted; one changed word or a missing end is not."""
    rnd = random.Random(3)
    full = [(label, t) for label, t in ls.TEMPLATES if (label, t) not in NOTICES]
    assert len(full) >= 18
    good, bad = [], []
    for label, template in full:
        for keep in (True, False):
            text = filled(template, keep, ["Jane", "Q", "Doe", "and", "Sons"], rnd)
            good.append((label, f"Copyright (c) {rnd.randint(1980, 2030)} Jane\n{text}\nEnd."))
            words = text.split()
            mandatory = [i for i, w in enumerate(words) if re.search("[A-Za-z]{4}", w) and w.isalpha() and w in MARK.sub(" ", re.sub(r"(?s)\[\[.*?\]\]|\{\{.*?\}\}", " ", template)).split()]
            for i in rnd.sample(mandatory, 4):
                bad.append((label, " ".join(words[:i] + ["otherword"] + words[i + 1 :])))
            body = words if words[-1].lower() != "conditions" else words[:-5]  # the optional last line
            bad.append((label, " ".join(body[: len(body) - 3])))
    got = scanned(spark, [t for _, t in good + bad])
    for i, (label, text) in enumerate(good):
        assert label in {m.label for m in got[i].matches}, (label, text)
    for i, (label, text) in enumerate(bad):
        assert label not in {m.label for m in got[len(good) + i].matches}, (label, text)


def test_query_columns(spark, tmp_path):
    rows = [(1, "x Apache License. Licensed under the Apache License"), (2, None), (3, "MIT license, Apache license")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op7_license_scan(spark, str(tmp_path)).collect())
    assert got == [
        (1, 8, 2, 1, 6, "apache", "apache,apache-notice", 1.0),
        (2, 0, 0, None, None, "", "", 0.0),
        (3, 4, 2, 0, 2, "apache,mit", "apache,mit", 0.5),
    ]
