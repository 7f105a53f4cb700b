"""License recognition by sentence rules (operator 4).

A text is cut into sentences, each normalised; those that hold known licence
wording are mapped to its identifiers, all others to a gap.  A rule is an ordered
sequence of identifiers; it matches where its identifiers stand in order with
at most ``gap`` other sentences between them.  Everything is a Spark
expression over the row: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free_prefix

# Wording of public licences and of their usual notices, as
# normalised parts of a sentence ("#" stands for a number).  None spans a mark
# at which STOP cuts the real text; names that users fill in are left out.
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache.licensed": "licensed under the apache license version #",
    "apache.use": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at",
    "gpl.work": "licensed under the gnu general public license",
    "gpl.free": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl.hope": "is distributed in the hope that it will be useful but without any warranty",
    "lgpl.work": "licensed under the gnu lesser general public license",
    "cc.by-nc": "licensed under cc by nc #",
    "cc.by-sa": "licensed under cc by sa #",
    "cc.by": "licensed under cc by #",
    "cc.work": "licensed under a creative commons attribution # international license",
    "cc0": "has waived all copyright and related or neighboring rights to",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "rights": "all rights reserved",
}
# every known sentence has one of these; a text without them has no known sentence
ANCHORS = ("licens", "rights", "notice", "redistribut", "permission", "warranty")
# (licence, identifiers in order); a longer match of a licence implies its shorter ones
RULES = [
    ("MIT", ["mit.released"]), ("MIT", ["mit.licensed"]), ("MIT", ["mit.grant", "mit.notice"]),
    ("Apache", ["apache.licensed"]),
    ("GPL", ["gpl.work"]), ("GPL", ["gpl.free", "gpl.hope"]), ("LGPL", ["lgpl.work"]),
    ("CC-BY-NC", ["cc.by-nc"]), ("CC-BY-SA", ["cc.by-sa"]), ("CC-BY", ["cc.by"]), ("CC-BY", ["cc.work"]),
    ("CC0", ["cc0"]),
    ("BSD-2-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary"]),
    ("BSD-3-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.names"]),
    ("MPL", ["mpl"]), ("All rights reserved", ["rights"]),
]
# a sentence ends at a line end or at ., !, ?, ; or : before white space or the end of the text
STOP = r"[.!?;:]+(?=[ \t\r\n]|$)"
BREAK = STOP + r"|[\r\n]+"
# wrapped lines go on; a line without letter or digit and one that opens with a dated copyright end a sentence
FLOW_BREAK = STOP + r"|(?i)(?:\r\n|\r(?!\n)|\n)(?=[^\p{L}\p{N}\r\n]*(?:[\r\n]|copyright\s*(?:\(c\)|©|[0-9])))"


def normalise(sentence: Column) -> Column:
    """Lower case; numbers become "#"; other runs of non-letters one space."""
    out = F.regexp_replace(F.translate(F.lower(sentence), "#", " "), r"[0-9]+(\.[0-9]+)*", "#")
    return F.trim(F.regexp_replace(out, r"[^a-z#]+", " "))


def sentence_ids(text: Column, ends: str = BREAK) -> Column:
    """Array of the identifiers that a text's sentences, cut at ``ends``, hold
    as whole words; a sentence that holds a word but no identifier gives ""."""
    known = F.create_map(*(F.lit(x) for s, i in ((s, i) for i, s in SENTENCES.items()) for x in (s, i)))
    wording = F.lit(r"(?<![a-z#])(?:" + "|".join(sorted(SENTENCES.values(), key=len, reverse=True)) + r")(?![a-z#])")
    parts = F.filter(F.transform(F.split(text, ends, -1), normalise), lambda s: s != "")
    ids = F.flatten(F.transform(parts, lambda s: F.when(
        F.rlike(s, wording), F.transform(F.regexp_extract_all(s, wording, F.lit(0)), lambda x: F.try_element_at(known, x)))
        .otherwise(F.array(F.lit("")))))
    return F.when(F.rlike(F.lower(text), F.lit("|".join(ANCHORS))), ids).otherwise(F.array().cast("array<string>"))


def rule_pattern(ids: list[str], gap: int) -> str:
    """Regular expression of a rule over identifiers that are each ended by a
    comma: in order, with at most ``gap`` other sentences between."""
    between = "(?:[^,]*,){0,%d}" % gap
    return "(?:^|,)" + between.join(re.escape(i) + "," for i in ids)


def scan_licenses(docs: DataFrame, *, text: str = "text", gap: int = 2, licenses_col: str = "licenses",
                  sentences_col: str = "license_sentences") -> DataFrame:
    """``docs`` with ``licenses`` (names in rule order, each once) and
    ``license_sentences`` (identifiers found, in text order).

    Sentences are read twice: cut at line ends too, which finds notices that
    stand in a line of their own, and with wrapped lines joined up to a blank
    line or a copyright line, which finds sentences wrapped over lines; rules
    are matched to either sequence.  Null and empty texts have none; texts of
    any length are read whole; repeated rows repeat their result; an empty
    table gives no rows.  Existing columns of these two names are replaced,
    all others kept.
    """
    mark = free_prefix(docs, "_license_")
    lines, flow, by_line, by_flow = (mark + n for n in ("lines", "flow", "by_line", "by_flow"))
    found = docs.withColumns({lines: sentence_ids(F.col(text)), flow: sentence_ids(F.col(text), FLOW_BREAK)})
    found = found.withColumns({by_line: F.concat(F.lit(","), F.array_join(lines, ","), F.lit(",")),
                               by_flow: F.concat(F.lit(","), F.array_join(flow, ","), F.lit(","))})
    matched = F.array(*(F.when(F.rlike(by_line, F.lit(rule_pattern(ids, gap)))
                               | F.rlike(by_flow, F.lit(rule_pattern(ids, gap))), name)
                        for name, ids in RULES))
    known = lambda c: F.filter(c, lambda i: i != "")
    return (found.withColumns({licenses_col: F.array_distinct(F.filter(matched, lambda n: n.isNotNull())),
                               sentences_col: F.when(F.size(known(lines)) >= F.size(known(flow)), known(lines))
                               .otherwise(known(flow))})
            .drop(lines, flow, by_line, by_flow))
