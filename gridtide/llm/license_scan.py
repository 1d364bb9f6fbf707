"""Licences by sentences: normalised sentences become identifiers, ordered rules match their sequences.

Two cuts. Lines and sentences that equal a short notice (``SENTENCES``, ``RULES``). And sentences of the text with its
wrapped lines joined (``STANDARD``, ``GRANTS``, ``TITLES``, ``STANDARD_RULES``): they end at blank lines and at full stops, begin at
``OPENINGS`` also after a heading or copyright line, and are known by how they begin. A grant may have its subject
before it ("Foo is licensed under"), unless the subject denies it. ``SPDX-License-Identifier`` lines name their licences.
All of it is DataFrame functions: one pass over the texts, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts, normalised (lower case, letters and digits, single spaces).
SENTENCES = {
    "copyright holders": "COPY",
    "all rights reserved": "RESERVED",
    "licensed under the apache license version 2 0": "APACHE-GRANT",
    "licensed under the apache license version 2 0 the license": "APACHE-GRANT",
    "you may not use this file except in compliance with the license": "APACHE-COMPLY",
    "you may obtain a copy of the license at": "APACHE-COPY",
    "released under the mit license": "MIT-GRANT",
    "licensed under the mit license": "MIT-GRANT",
    "this project is licensed under the mit license": "MIT-GRANT",
    "permission is hereby granted free of charge to any person obtaining a copy": "MIT-PERMIT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "the software is provided as is without warranty of any kind": "AS-IS",
    "redistribution and use in source and binary forms with or without modification are permitted": "BSD-PERMIT",
    "redistributions of source code must retain the above copyright notice": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice": "BSD-BINARY",
    "this work is licensed under the gnu general public license version 3": "GPL3-GRANT",
    "licensed under the gnu general public license version 3": "GPL3-GRANT",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "GPL-TERMS",
    "licensed under cc by nc 4 0": "CC-BY-NC-GRANT",
    "licensed under cc by 4 0": "CC-BY-GRANT",
    "licensed under cc by sa 4 0": "CC-BY-SA-GRANT",
}
# Rules in the order they apply: licence, group, identifiers that follow each other.
RULES = [
    ("Apache-2.0", "permissive", ("APACHE-GRANT", "APACHE-COMPLY", "APACHE-COPY")),
    ("MIT", "permissive", ("MIT-PERMIT", "MIT-NOTICE", "AS-IS")),
    ("BSD", "permissive", ("BSD-PERMIT", "BSD-SOURCE", "BSD-BINARY")),
    ("Apache-2.0", "permissive", ("APACHE-GRANT",)),
    ("MIT", "permissive", ("MIT-GRANT",)),
    ("MIT", "permissive", ("MIT-PERMIT",)),
    ("BSD", "permissive", ("BSD-PERMIT",)),
    ("GPL-3.0", "copyleft", ("GPL3-GRANT",)),
    ("GPL", "copyleft", ("GPL-TERMS",)),
    ("CC-BY-NC-4.0", "restricted", ("CC-BY-NC-GRANT",)),
    ("CC-BY-SA-4.0", "copyleft", ("CC-BY-SA-GRANT",)),
    ("CC-BY-4.0", "permissive", ("CC-BY-GRANT",)),
    ("all-rights-reserved", "restricted", ("RESERVED",)),
]
GROUPS = ("restricted", "copyleft", "permissive")  # the strictest one found is the document's
BREAK = r"\n+|[.!?;:]+[ \t\r]+"

# How sentences of the standard texts begin, normalised; * stands for a project's own words.
STANDARD = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-PERMIT",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "MIT-0-PERMIT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT-AS-IS",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-PERMIT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSD-ADVERTISING",
    "all advertising materials mentioning features or use of this software must display the following acknowledgment": "BSD-ADVERTISING",
    "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-NAME",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "BSD-NAME",
    "the end user documentation included with the redistribution if any must include the following acknowledgment": "APACHE-1-ACKNOWLEDGE",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "APACHE-2-COMPLY",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "APACHE-2-COPYRIGHT",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "GPL-3",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "LGPL-3",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "AGPL-3",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license": "GFDL-TERMS",
    "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package": "ARTISTIC-1",
    "the contents of this file are subject to the mozilla public license version 1 1": "MPL-11",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-PERMIT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-PERMIT",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD-PERMIT",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB-PERMIT",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL-PERMIT",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
    "to the extent possible under law * waived all copyright and related or neighboring rights to": "CC0-WAIVER",
}
# Titles of the standard texts: the whole sentence, or followed by the text's own next words (``TITLE_END``).
TITLES = {
    "gnu general public license version 2 june 1991": "GPL-2",
    "gnu library general public license version 2 june 1991": "LGPL-2",
    "gnu lesser general public license version 2 1 february 1999": "LGPL-21",
    "mozilla public license version 2 0": "MPL-2",
    "cc0 1 0 universal": "CC0-WAIVER",
}
TITLE_END = r"(?:$| 1$| copyright | creative commons )"
# Grants: the sentence may begin with its subject.
GRANTS = {
    "licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license": "APACHE-2-COMPLY",
    "made available under the terms of the eclipse public license v1 0": "EPL-1",
    "made available under the terms of the eclipse public license v 2 0": "EPL-2",
    "made available under the terms of the eclipse public license 2 0": "EPL-2",
    "distributed under the boost software license version 1 0": "BSL-PERMIT",
    "licensed under the apache license version 2 0": "APACHE-2-GRANT",
    "released under the mit license": "MIT-GRANT",
    "licensed under the mit license": "MIT-GRANT",
    "licensed under the gnu general public license version 3": "GPL-3-GRANT",
    "licensed under cc by nc 4 0": "CC-BY-NC-4-GRANT",
    "licensed under cc by sa 4 0": "CC-BY-SA-4-GRANT",
    "licensed under cc by 4 0": "CC-BY-4-GRANT",
}
_GNU = "redistribute it and or modify it under the terms of the gnu {} general public license"
_FSF = "as published by the free software foundation"
for _kind, _of, _versions in (("", "GPL", {"2": "2", "3": "3"}), ("lesser", "LGPL", {"2 1": "21", "3": "3", "2": "2"}),
                              ("library", "LGPL", {"2": "2"}), ("affero", "AGPL", {"3": "3"})):
    _terms = " ".join(_GNU.format(_kind).split())
    GRANTS[_terms] = f"{_of}-TERMS"
    for _words, _number in _versions.items():
        for _rest in (f"{_FSF} either version {_words}", f"{_FSF} version {_words}", f"version {_words} {_FSF}", f"version {_words}"):
            GRANTS[f"{_terms} {_rest}"] = f"{_of}-{_number}"
# Rules over the standard sentences that follow each other, longer sequences first.
_BSD = ("BSD-PERMIT", "BSD-SOURCE", "BSD-BINARY")
STANDARD_RULES = [
    ("Apache-1.1", "permissive", (*_BSD, "APACHE-1-ACKNOWLEDGE")),
    ("BSD-4-Clause", "permissive", (*_BSD, "BSD-ADVERTISING", "BSD-NAME")),
    ("BSD-3-Clause", "permissive", (*_BSD, "BSD-NAME")),
    ("BSD-2-Clause", "permissive", _BSD),
    ("BSD", "permissive", ("BSD-PERMIT",)),
    ("Apache-2.0", "permissive", ("APACHE-2-COMPLY",)),
    ("Apache-2.0", "permissive", ("APACHE-2-COPYRIGHT",)),
    ("Apache-2.0", "permissive", ("APACHE-2-GRANT",)),
    ("MIT", "permissive", ("MIT-PERMIT",)),
    ("MIT", "permissive", ("MIT-GRANT",)),
    ("MIT-0", "permissive", ("MIT-0-PERMIT",)),
    ("ISC", "permissive", ("ISC-PERMIT",)),
    ("0BSD", "permissive", ("0BSD-PERMIT",)),
    ("Zlib", "permissive", ("ZLIB-PERMIT",)),
    ("BSL-1.0", "permissive", ("BSL-PERMIT",)),
    ("Unlicense", "permissive", ("UNLICENSE",)),
    ("CC0-1.0", "permissive", ("CC0-WAIVER",)),
    ("GPL-2.0", "copyleft", ("GPL-2",)),
    ("GPL-3.0", "copyleft", ("GPL-3",)),
    ("GPL-3.0", "copyleft", ("GPL-3-GRANT",)),
    ("GPL", "copyleft", ("GPL-TERMS",)),
    ("LGPL-2.0", "copyleft", ("LGPL-2",)),
    ("LGPL-2.1", "copyleft", ("LGPL-21",)),
    ("LGPL-3.0", "copyleft", ("LGPL-3",)),
    ("LGPL", "copyleft", ("LGPL-TERMS",)),
    ("AGPL-3.0", "copyleft", ("AGPL-3",)),
    ("AGPL", "copyleft", ("AGPL-TERMS",)),
    ("GFDL", "copyleft", ("GFDL-TERMS",)),
    ("Artistic-1.0", "permissive", ("ARTISTIC-1",)),
    ("MPL-1.1", "copyleft", ("MPL-11",)),
    ("MPL-2.0", "copyleft", ("MPL-2",)),
    ("EPL-1.0", "copyleft", ("EPL-1",)),
    ("EPL-2.0", "copyleft", ("EPL-2",)),
    ("CC-BY-NC-4.0", "restricted", ("CC-BY-NC-4-GRANT",)),
    ("CC-BY-SA-4.0", "copyleft", ("CC-BY-SA-4-GRANT",)),
    ("CC-BY-4.0", "permissive", ("CC-BY-4-GRANT",)),
]
for _kind, _name, _group in (("attribution", "CC-BY", "permissive"), ("attribution sharealike", "CC-BY-SA", "copyleft"),
                             ("attribution noncommercial", "CC-BY-NC", "restricted"), ("attribution noderivatives", "CC-BY-ND", "restricted"),
                             ("attribution noncommercial sharealike", "CC-BY-NC-SA", "restricted"),
                             ("attribution noncommercial noderivatives", "CC-BY-NC-ND", "restricted")):
    for _version in ("3", "4"):
        GRANTS |= {f"licensed under {_a} creative commons {_kind} {_version} 0": f"{_name}-{_version}-GRANT" for _a in ("a", "the")}
        if (_name, _version) not in (("CC-BY", "4"), ("CC-BY-SA", "4"), ("CC-BY-NC", "4")):
            STANDARD_RULES.append((f"{_name}-{_version}.0", _group, (f"{_name}-{_version}-GRANT",)))
SPDX = {}  # normalised names after SPDX-License-Identifier
for _name, _group in dict((_name, _group) for _name, _group, _ in STANDARD_RULES if _name not in ("BSD", "GPL", "LGPL", "AGPL", "GFDL")).items():
    _plain = re.sub("[^a-z0-9]+", " ", _name.lower())
    SPDX |= {_plain + _end: f"SPDX-{_name}" for _end in ("", " only", " or later")}
    STANDARD_RULES.append((_name, _group, (f"SPDX-{_name}",)))
# Words a sentence begins with, as they are written, where a heading, a copyright line or a comment before them has no full stop.
OPENINGS = (
    "Permission is hereby granted", "Permission to use, copy", "Permission is granted to", "The above copyright notice and this permission",
    "THE SOFTWARE IS PROVIDED", "Redistribution and use in source", "Redistributions of source code", "Redistributions in binary form",
    "Neither the name of", "The name of the author may not", "All advertising materials", "Licensed under the Apache License, Version 2.0 (the",
    "This Source Code Form is subject", "The contents of this file are subject", "This is free and unencumbered software",
    "GNU GENERAL PUBLIC LICENSE", "GNU LESSER GENERAL PUBLIC", "GNU LIBRARY GENERAL PUBLIC", "CC0 1.0 Universal", "To the extent possible under law",
)
DENIALS = ("cannot", "false", "if", "never", "no", "none", "nor", "not", "nothing", "unless", "whether", "without")  # a subject with one of them grants nothing
HINTS = ("licens", "software", "permission", "redistribut", "universal", "waived", "copied")  # each standard sentence has one of these words
RESERVED = "all-rights-reserved"  # says nothing beside a standard licence text, which often begins with it


def sentences_of(text: Column) -> Column:
    """Normalised sentences with a letter or digit, in order."""
    plain = F.transform(F.split(text, BREAK), lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(plain, lambda s: s != "")


def _marks(ids: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in ids)


def _beginnings() -> str:
    """A sentence's beginning as a pattern for Java and RE2: 1 text or title, 2 title, 3 subject of a grant, 4 grant."""
    def either(table):
        return "|".join(k.replace(" * ", " .+ ") for k in sorted(table, key=len, reverse=True))
    subject = "(?:[a-z0-9]+ ){1,12}(?:is|are|asf) (?:free software )?(?:you (?:can|may) )?|you (?:can|may) |"
    return f"^(?:({either(STANDARD)})(?: |$)|({either(TITLES)}){TITLE_END}|({subject})({either(GRANTS)})(?: |$))"


# Steps from a text to its sentences, for Java and RE2: blank lines end a sentence, "v. 2" does not, openings begin one.
BLANK = r"\n[^A-Za-z0-9]*\n"
VERSION = r"([^A-Za-z0-9][vV])\.[ \t\r\n]+([0-9])"
OPENING = "([^A-Za-z0-9])(" + "|".join("[^A-Za-z0-9]+".join(re.findall("[A-Za-z0-9]+", x)) for x in OPENINGS) + ")"
STOP = r"[.!?][\x22')\]]*[ \t\r\n]+"
BEGINNING = _beginnings()
DENIED = f"(?:^| )(?:{'|'.join(DENIALS)}) "
SPDX_LINE = r"spdx-license-identifier:[^\n]*"
SPDX_NAME = "(?:^| )(?:" + "|".join(sorted(SPDX, key=len, reverse=True)) + ")(?: |$)"


def _table(of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def _plain(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def standard_ids(text: Column) -> Column:
    """Identifiers of the standard sentences in a text that is not null, in order, then those of SPDX lines: ``<A><B>``."""
    fixed = _table({k: v for k, v in (STANDARD | TITLES | GRANTS).items() if " * " not in k})

    def name(sentence: Column) -> Column:
        said = [F.regexp_extract(sentence, BEGINNING, i) for i in (1, 2, 3, 4)]
        begins = F.concat(said[0], said[1], F.when(~said[2].rlike(DENIED), said[3]).otherwise(""))
        known = F.try_element_at(fixed, begins)
        for key in STANDARD:
            if " * " in key:
                known = F.coalesce(known, F.when(begins.startswith(key.split(" * ")[0] + " "), STANDARD[key]))
        return F.coalesce(F.concat(F.lit("<"), known, F.lit(">")), F.lit(""))
    hinted = F.lit(False)
    for hint in HINTS:
        hinted = hinted | F.lower(text).contains(hint)
    cut = F.regexp_replace(F.regexp_replace(text, BLANK, ". "), VERSION, "$1 $2")
    sentences = F.transform(F.split(F.regexp_replace(cut, OPENING, "$1. $2"), STOP), _plain)
    known = F.transform(F.filter(sentences, lambda x: x.rlike(BEGINNING)), name)
    lines = F.transform(F.regexp_extract_all(F.lower(text), F.lit(SPDX_LINE), F.lit(0)), _plain)
    tagged = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(SPDX_NAME), F.lit(0))))
    spdx = F.transform(tagged, lambda x: F.concat(F.lit("<"), F.try_element_at(_table(SPDX), F.btrim(x)), F.lit(">")))
    return F.when(hinted, F.array_join(F.concat(known, spdx), "")).otherwise("")


def _standard_licences(ids: Column) -> Column:
    """The licences whose rules match standard sentences, in rule order; what a rule has matched is spent."""
    longest = sorted(STANDARD_RULES, key=lambda rule: -len(rule[2]))
    table = F.create_map(*[F.lit(x) for name, _, wanted in longest for x in (_marks(wanted), name)])
    pattern = "|".join(re.escape(_marks(wanted)) for _, _, wanted in longest)
    found = F.transform(F.regexp_extract_all(ids, F.lit(pattern), F.lit(0)), lambda x: F.try_element_at(table, x))
    return F.array_intersect(F.array(*[F.lit(name) for name, _, _ in STANDARD_RULES]), found)


def scan_licences(docs: DataFrame, text_col: str = "text", sentences: dict[str, str] | None = None, rules=None) -> DataFrame:
    """``docs`` with ``n_sentences``, ``sentence_ids``, ``standard_ids``, ``licences``, ``licence_group``.

    ``sentence_ids`` are the known short sentences' identifiers in order, ``<>`` for each one unknown sentence or
    run of them in between; ``standard_ids`` those of the standard texts' sentences, with wrapped lines joined, and of SPDX lines.
    ``licences`` are the names of all rules that match, in rule order, those of standard sentences last, joined by
    commas; "all rights reserved" is none beside a standard text. What a rule has matched is spent for later rules.
    ``licence_group`` is the strictest of the matched rules'. Texts without a known sentence, null texts among them, have empty strings and a null group. Rows stand alone:
    repeated ones get equal results. Columns with the new names are replaced, others pass. The two tables of
    sentences and rules are configuration and go into the plan.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    table = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    step = docs.drop("n_sentences", "sentence_ids", "standard_ids", "licences", "licence_group")
    step = step.withColumn("standard_ids", standard_ids(F.coalesce(F.col(text_col), F.lit(""))))
    step = step.withColumn("_standard", _standard_licences(F.col("standard_ids")))
    step = step.withColumn("_s", sentences_of(F.coalesce(F.col(text_col), F.lit(""))))
    ids = F.array_join(F.transform("_s", lambda s: F.concat(F.lit("<"), F.coalesce(F.try_element_at(table, s), F.lit("")), F.lit(">"))), "")
    step = step.withColumns({"n_sentences": F.size("_s").cast("long"), "_ids": F.regexp_replace(ids, "(<>)+", "<>")})
    step = step.withColumn("sentence_ids", F.when(F.col("_ids") == "<>", "").otherwise(F.col("_ids"))).drop("_s", "_ids")
    step = step.withColumn("_left", F.col("sentence_ids"))
    for i, (_, _, wanted) in enumerate(rules):
        step = step.withColumns({f"_hit{i}": F.col("_left").contains(_marks(wanted)),
                                 "_left": F.replace(F.col("_left"), F.lit(_marks(wanted)), F.lit("<>"))})
    names = F.array_compact(F.array(*[F.when(F.col(f"_hit{i}"), name) for i, (name, _, _) in enumerate(rules)]))
    texts = sorted({wanted[0] for _, _, wanted in STANDARD_RULES if not wanted[0].endswith("-GRANT")})
    said = F.col("standard_ids").rlike(f"<({'|'.join(texts)})>")
    names = F.when(said, F.array_remove(names, RESERVED)).otherwise(names)
    step = step.withColumn("_names", F.array_distinct(F.concat(names, "_standard")))
    group = F.lit(None).cast("string")
    for wanted_group in reversed(GROUPS):
        standard = [name for name, of, _ in STANDARD_RULES if of == wanted_group]
        any_hit = F.arrays_overlap("_standard", F.array(*map(F.lit, standard)))
        for i, (name, of, _) in enumerate(rules):
            any_hit = any_hit | (F.col(f"_hit{i}") & ~(F.lit(name == RESERVED) & said)) if of == wanted_group else any_hit
        group = F.when(any_hit, wanted_group).otherwise(group)
    step = step.withColumns({"licences": F.array_join("_names", ","), "licence_group": group})
    return step.drop("_left", "_standard", "_names", *[f"_hit{i}" for i in range(len(rules))])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licence_sql(table: str, columns: str) -> str:
    """The same scan as DuckDB SQL over ``table`` with a ``text`` column; returns ``columns`` and the new ones."""
    plain = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    lines = " ".join(f"WHEN '{s}' THEN '<{i}>'" for s, i in SENTENCES.items())
    begins = " ".join(f"WHEN b = '{s}' THEN '<{i}>'" for s, i in (STANDARD | TITLES | GRANTS).items() if " * " not in s)
    begins += "".join(f" WHEN starts_with(b, '{s.split(' * ')[0]} ') THEN '<{i}>'" for s, i in STANDARD.items() if " * " in s)
    spdx = " ".join(f"WHEN '{s}' THEN '<{i}>'" for s, i in SPDX.items())
    longest = sorted(STANDARD_RULES, key=lambda rule: -len(rule[2]))
    spent = "|".join(re.escape(_marks(wanted)) for _, _, wanted in longest)
    matched = " ".join(f"WHEN '{_marks(wanted)}' THEN '{name}'" for name, _, wanted in longest)
    in_order = ", ".join(f"'{name}'" for name in dict.fromkeys(name for name, _, _ in STANDARD_RULES))
    texts = "|".join(sorted({wanted[0] for _, _, wanted in STANDARD_RULES if not wanted[0].endswith("-GRANT")}))
    group_of = " ".join(f"WHEN '{name}' THEN '{of}'" for name, of in {name: of for name, of, _ in STANDARD_RULES}.items())
    hinted = " OR ".join(f"contains(lower(t), '{hint}')" for hint in HINTS)
    said = [f"regexp_extract(x, {_quoted(BEGINNING)}, {i})" for i in (1, 2, 3, 4)]
    ctes = [f"""
a0 AS (SELECT {columns}, coalesce(text, '') AS t FROM {table}),
a1 AS (SELECT {columns}, t, list_filter(list_transform(regexp_split_to_array(t, '\\n+|[.!?;:]+[ \\t\\r]+'), lambda x: {plain.format('x')}), lambda x: x <> '') AS s,
       CASE WHEN {hinted} THEN list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(t,
         {_quoted(BLANK)}, '. ', 'g'), {_quoted(VERSION)}, '\\1 \\2', 'g'), {_quoted(OPENING)}, '\\1. \\2', 'g'), {_quoted(STOP)}),
         lambda x: {plain.format('x')}), lambda x: regexp_matches(x, {_quoted(BEGINNING)})) ELSE [] END AS known,
       list_transform(regexp_extract_all(lower(t), {_quoted(SPDX_LINE)}), lambda x: {plain.format('x')}) AS tags FROM a0),
a2 AS (SELECT {columns}, len(s) AS n_sentences,
       regexp_replace(array_to_string(list_transform(s, lambda x: CASE x {lines} ELSE '<>' END), ''), '(<>)+', '<>', 'g') AS ids,
       list_transform(known, lambda x: {said[0]} || {said[1]} || CASE WHEN regexp_matches({said[2]}, {_quoted(DENIED)}) THEN '' ELSE {said[3]} END) AS known,
       flatten(list_transform(tags, lambda x: regexp_extract_all(x, {_quoted(SPDX_NAME)}))) AS tags FROM a1),
a3 AS (SELECT {columns}, n_sentences, ids, coalesce(array_to_string(list_transform(known, lambda b: CASE {begins} ELSE '' END), ''), '')
       || coalesce(array_to_string(list_transform(tags, lambda x: CASE trim(x) {spdx} END), ''), '') AS standard_ids FROM a2),
a4 AS (SELECT {columns}, n_sentences, CASE WHEN ids IS NULL OR ids = '<>' THEN '' ELSE ids END AS sentence_ids, standard_ids,
       list_transform(regexp_extract_all(standard_ids, {_quoted(spent)}), lambda x: CASE x {matched} END) AS found,
       regexp_matches(standard_ids, '<({texts})>') AS said FROM a3),
r0 AS (SELECT {columns}, n_sentences, sentence_ids, sentence_ids AS rest, standard_ids, said, []::VARCHAR[] AS names, []::VARCHAR[] AS groups,
       list_filter([{in_order}], lambda x: list_contains(found, x)) AS standard FROM a4)"""]
    for i, (name, group, wanted) in enumerate(RULES):
        hit = f"contains(rest, '{_marks(wanted)}')" + (" AND NOT said" if name == RESERVED else "")
        ctes.append(f"""r{i + 1} AS (SELECT {columns}, n_sentences, sentence_ids, standard_ids, said, standard, replace(rest, '{_marks(wanted)}', '<>') AS rest,
       CASE WHEN {hit} AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names,
       CASE WHEN {hit} THEN list_append(groups, '{group}') ELSE groups END AS groups FROM r{i})""")
    ctes.append(f"""z AS (SELECT *, list_concat(groups, list_transform(standard, lambda x: CASE x {group_of} END)) AS strict,
       list_concat(names, list_filter(standard, lambda x: NOT list_contains(names, x))) AS every FROM r{len(RULES)})""")
    strict = " ".join(f"WHEN list_contains(strict, '{g}') THEN '{g}'" for g in GROUPS)
    return f"""WITH {', '.join(ctes)} SELECT {columns}, n_sentences, sentence_ids, standard_ids,
       array_to_string(every, ',') AS licences, CASE {strict} END AS licence_group FROM z"""
