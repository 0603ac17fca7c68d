"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised and looked up among known licence sentences; the sequence of sentence identifiers that
results is then matched against rules, each an ordered list of identifiers. A notice is what a rule matches, whatever stands between.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Sentence identifier -> patterns of normalised sentences (lower case, one space between words, quotes and list marks gone).
SENTENCES: dict[str, tuple[str, ...]] = {
    "spdx": (r"spdx[- ]license[- ]identifier ?:? (?P<id>[a-z0-9.+-]+)",),
    "apache-2.0-line": (r"(?:this (?:work|file|software|code|project) is )?(?:licensed|released|distributed|available) under (?:the )?apache(?: software)? licen[cs]e,? (?:version )?2(?:\.0)?(?: \(the license\))?(?:;.*)?",),
    "apache-2.0-use": (r"you may not use this file except in compliance with the license",),
    "apache-2.0-copy": (r"you may obtain a copy of the license at(?: https?://www\.apache\.org/licenses/license-2\.0)?",),
    "apache-2.0-asis": (r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",),
    "mit-line": (r"(?:this (?:work|file|software|code|project) is )?(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:mit|expat) licen[cs]e(?:;.*)?", r"(?:the )?mit licen[cs]e(?: \(mit\))?"),
    "mit-grant": (r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the software\), to deal in the software without restriction.*",),
    "mit-notice": (r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-asis": (r"the software is provided as is, without warranty of any kind, express or implied.*",),
    "bsd-2-line": (r"(?:this (?:work|file|software|code|project) is )?(?:licensed|released|distributed|available) under (?:the )?(?:simplified |2-clause |two-clause )bsd (?:2-clause )?licen[cs]e", r".*under (?:the )?bsd[- ]2[- ]clause(?: licen[cs]e)?"),
    "bsd-3-line": (r"(?:this (?:work|file|software|code|project) is )?(?:licensed|released|distributed|available) under (?:the )?(?:new |modified |revised |3-clause |three-clause )?bsd licen[cs]e", r".*under (?:the )?bsd[- ]3[- ]clause(?: licen[cs]e)?"),
    "bsd-redistribution": (r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:?",),
    "bsd-source": (r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": (r"redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.*",),
    "bsd-endorse": (r"neither the name of .* nor the names of its contributors may be used to endorse or promote products.*",),
    "gpl-3-line": (r".*(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e,? (?:version |v)?3(?:\.0)?(?P<later> or (?:any )?later(?: version)?|,? or \(at your option\) any later version)?", r".*under (?:the )?gplv?3"),
    "gpl-2-line": (r".*(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e,? (?:version |v)?2(?:\.0)?(?P<later> or (?:any )?later(?: version)?|,? or \(at your option\) any later version)?", r".*under (?:the )?gplv?2"),
    "gpl-line": (r".*(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?:;.*|, .*)?",),
    "lgpl-line": (r".*(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu (?:lesser|library) general public licen[cs]e(?:,? (?:version |v)?(?P<version>2\.1|2|3)(?:\.0)?)?.*",),
    "agpl-line": (r".*(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu affero general public licen[cs]e.*",),
    "gnu-free": (r"(?:this program|this library|.*) is free software[:;]? you can redistribute it and/or modify it under the terms of the gnu (?P<kind>general|lesser general|affero general) public license as published by the free software foundation[,;]? either version (?P<version>[0-9.]+) of the license,? or \(at your option\) any later version",),
    "gnu-hope": (r".* is distributed in the hope that it will be useful, but without any warranty.*",),
    "gnu-copy": (r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with this (?:program|library).*",),
    "mpl-line": (r".*(?:licensed|released|distributed|available|subject to the terms) (?:under|of) (?:the )?(?:terms of the )?mozilla public licen[cs]e,? (?:version |v\. ?|v)?(?P<version>2\.0|1\.1)",),
    "isc-line": (r".*(?:licensed|released|distributed|available) under (?:the )?isc licen[cs]e",),
    "isc-grant": (r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.*",),
    "unlicense": (r"this is free and unencumbered software released into the public domain", r".*under (?:the )?unlicense"),
    "public-domain": (r".*(?:dedicated|released|placed) (?:to|into|in) the public domain",),
    "cc0": (r".*\b(?:cc0|creative commons zero)\b(?: 1\.0)?(?: universal)?.*",),
    "cc": (r".*(?:licensed|released|distributed|available|shared) under (?:a |the )?(?:creative commons|cc)[ -](?P<parts>by(?:-nc)?(?:-sa|-nd)?|attribution(?:[- ]noncommercial)?(?:[- ](?:sharealike|noderivatives|noderivs))?)[ -]?(?P<version>[1-4]\.[05])?.*",),
    "rights": (r"all rights reserved",),
    "copyright": (r"(?:copyright|\(c\)|©)(?: \(c\)| ©)? (?:[0-9]{4}(?:[-, ]+[0-9]{4})*),? .+",),
    # the licence texts themselves
    "gpl-3-text": (r"the gnu general public license is a free, copyleft license for software and other kinds of works",),
    "gpl-2-text": (r"the licenses for most software are designed to take away your freedom to share and change it",),
    "lgpl-text": (r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license, supplemented by the additional permissions listed below",),
    "agpl-text": (r"the gnu affero general public license is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",),
    "mpl-notice": (r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0",),
    "mpl-copy": (r"if a copy of the mpl was not distributed with this file, you can obtain one at https?://(?:www\.)?mozilla\.org/mpl/2\.0/?",),
    "epl-text": (r"the accompanying program is provided under the terms of this eclipse public license \(agreement\)", r"this program and the accompanying materials are made available under the terms of the eclipse public license v? ?(?:2\.0|1\.0).*"),
    "cc-text": (r"by exercising the licensed rights \(defined below\), you accept and agree to be bound by the terms and conditions of this creative commons (?P<parts>attribution(?:-noncommercial)?(?:-(?:sharealike|noderivatives))?) (?P<version>4\.0) international public license \(public license\)",),
    "zlib-asis": (r"this software is provided as-is, without any express or implied warranty",),
    "zlib-grant": (r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.*",),
    "bsl-grant": (r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*",),
    "apache-text": (r"subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce.*",),
}

#: Ordered rules (licence, sentence identifiers in their order). An earlier rule takes its sentences first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-2.0-line", "apache-2.0-use", "apache-2.0-copy", "apache-2.0-asis")),
    ("Apache-2.0", ("apache-2.0-use", "apache-2.0-copy")),
    ("Apache-2.0", ("apache-2.0-line",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-line",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-2-line",)),
    ("BSD-3-Clause", ("bsd-3-line",)),
    ("GNU", ("gnu-free", "gnu-hope", "gnu-copy")),
    ("GNU", ("gnu-free",)),
    ("GPL-3.0", ("gpl-3-line",)),
    ("GPL-2.0", ("gpl-2-line",)),
    ("GPL", ("gpl-line",)),
    ("LGPL", ("lgpl-line",)),
    ("AGPL-3.0", ("agpl-line",)),
    ("MPL", ("mpl-line",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-line",)),
    ("Unlicense", ("unlicense",)),
    ("public-domain", ("public-domain",)),
    ("CC0-1.0", ("cc0",)),
    ("CC", ("cc",)),
    ("SPDX", ("spdx",)),
    ("GPL-3.0", ("gpl-3-text",)),
    ("GPL-2.0", ("gpl-2-text",)),
    ("LGPL-3.0", ("lgpl-text",)),
    ("AGPL-3.0", ("agpl-text",)),
    ("MPL-2.0", ("mpl-notice", "mpl-copy")),
    ("MPL-2.0", ("mpl-notice",)),
    ("EPL", ("epl-text",)),
    ("CC", ("cc-text",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("BSL-1.0", ("bsl-grant",)),
    ("Apache-2.0", ("apache-text",)),
    ("proprietary", ("copyright", "rights")),
    ("proprietary", ("rights",)),
)
#: Identifiers as they are written.
SPDX = {i.lower(): i for i in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")}
#: A sentence that holds none of these words is no licence sentence.
_HINT = re.compile(r"licen[cs]|permission|redistribut|copyright|warrant|free software|public domain|rights reserved|cc0|gpl|obtain a copy|spdx|©|\(c\)|received a copy|neither the name|unencumbered|permitted|in compliance|under the (?:mit|bsd)|free, copyleft|licensed rights|granted to anyone|eclipse public", re.IGNORECASE)
#: Characters around a hint word in which a sentence's begin and end are looked for; well above the longest known sentence.
REACH = 2000
#: Characters that may stand between two sentences of one notice; farther apart they belong to two.
APART = 5000
_STOP = re.compile(r"(?<=[.!?])[)\"']*\s+")
_LINE = re.compile(r"[^\n]+")
_COMMENT = re.compile(r"[ \t]*(?:(?://+|#+|\*+(?!/)|;+|--+|%+|>+|\|+)[ \t]*)?")
#: A line with nothing but a comment's marks parts sentences too.
_BLANK = re.compile(r"\n(?:[ \t\r#*/;|>%-]*\n)+")
_MARK = re.compile(r"^[\s#*/;|>%-]+|^\s*(?:\(?[0-9a-z]{1,2}[.)])\s+")


@dataclass(frozen=True)
class Sentence:
    start: int
    end: int
    kind: str
    fields: dict[str, str]


def normal(sentence: str) -> str:
    """Lower case, marks of comments and lists gone, quotes gone, one space between words, no full stop at the end."""
    s = _MARK.sub("", sentence.lower())
    s = re.sub(r"[\"'`´“”‘’*]", "", s)
    return re.sub(r"\s+", " ", s).strip().rstrip(".!;:, ")


class Recogniser:
    def __init__(self, sentences: dict[str, tuple[str, ...]] | None = None, rules=None):
        self.patterns = [(k, re.compile(p)) for k, ps in (sentences or SENTENCES).items() for p in ps]
        self.rules = rules or RULES
        self.known: dict[str, tuple[str, dict[str, str]] | None] = {}

    def identify(self, sentence: str) -> tuple[str, dict[str, str]] | None:
        """The identifier of a sentence and what its pattern names; the same sentence is looked up once."""
        key = normal(sentence)
        if key in self.known:
            return self.known[key]
        found = next(((k, {n: v for n, v in m.groupdict().items() if v}) for k, p in self.patterns if (m := p.fullmatch(key))), None)
        if len(key) <= 2000:  # longer ones are looked up each time, so that what is kept stays small
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = found
        return found

    def sentences(self, text: str) -> list[Sentence]:
        """The known licence sentences of a text, in their order. They run on over lines, without the lines' comment marks, up to a blank line."""
        out, at = [], 0
        for gap in chain(_BLANK.finditer(text), (None,)):
            end = gap.start() if gap else len(text)
            if _HINT.search(text, at, end):
                out += self.paragraph(text, at, end)
            at = gap.end() if gap else end
        return out

    def paragraph(self, text: str, first: int, last: int) -> list[Sentence]:
        """The sentences between two blank lines: lines are joined, and places in the joined text are mapped back."""
        froms, tos, parts, n = [], [], [], 0
        for line in _LINE.finditer(text, first, last):
            begin = _COMMENT.match(text, line.start(), line.end()).end() if parts else line.start()
            froms.append(begin)
            tos.append(n)
            parts.append(text[begin : line.end()])
            n += line.end() - begin + 1
        joined = "\n".join(parts)
        back = lambda k: froms[(j := bisect_right(tos, k) - 1)] + k - tos[j]
        stops = [m.span() for m in _STOP.finditer(joined)]
        stop_at, stop_to = [x for x, _ in stops] + [len(joined)], [0] + [y for _, y in stops]
        out, done, tried = [], -1, set()
        for hint in _HINT.finditer(joined):
            if hint.start() < done:
                continue
            line = bisect_right(tos, hint.start()) - 1
            whole = stop_to[bisect_right(stop_to, hint.start()) - 1]
            # the hint's own line first, then lines before it back to the sentence's start
            first_line = bisect_left(tos, max(whole + 1, hint.start() - REACH))
            begins = dict.fromkeys([max(tos[line], whole), *reversed(tos[first_line:line]), whole])
            # every line's end up to the next full stop but one, as a stop may be part of a version
            j = bisect_left(stop_at, hint.end())
            last_stop = stop_at[min(j + 3, len(stop_at) - 1)]
            lines = [t - 1 for t in tos[line + 1 : bisect_right(tos, min(last_stop, hint.end() + REACH))]]
            ends = sorted({*lines, *stop_at[j : j + 4]})
            for begin, end in ((x, y) for x in begins for y in ends if x >= done):
                if (begin, end) in tried:
                    continue
                tried.add((begin, end))
                if found := self.identify(joined[begin:end]):
                    start = begin + len(joined[begin:end]) - len(joined[begin:end].lstrip())
                    out.append(Sentence(back(start), back(end - 1) + 1, *found))
                    done = end
                    break
        return out

    def notices(self, text: str) -> list[tuple[str, int, int, str]]:
        """(licence, start, end, sentence identifiers) by rule: a rule's sentences in their order, others may stand between, APART at most.

        Each rule looks at what earlier ones have left, once from front to back; a rule's first sentence begins it anew.
        """
        left, out = self.sentences(text), []
        for name, wanted in self.rules:
            taken, used = [], set()
            for k, s in enumerate(left):
                if taken and s.start - left[taken[-1]].end > APART:
                    taken = []
                if s.kind == wanted[len(taken)]:
                    taken.append(k)
                elif s.kind == wanted[0]:
                    taken = [k]
                if len(taken) == len(wanted):
                    own = [left[i] for i in taken]
                    out.append((resolve(name, {n: v for x in own for n, v in x.fields.items()}), own[0].start, own[-1].end, "+".join(wanted)))
                    used.update(taken)
                    taken = []
            left = [s for k, s in enumerate(left) if k not in used] if used else left
        return sorted(out, key=lambda r: (r[1], r[2], r[0]))


def resolve(name: str, fields: dict[str, str]) -> str:
    """The licence's identifier, completed by version and variant where a sentence names them."""
    version, later = fields.get("version"), "-or-later" if fields.get("later") else ""
    if name == "SPDX":
        return SPDX.get(fields["id"], fields["id"])
    if name == "GNU":
        letter = {"general": "GPL", "lesser general": "LGPL", "affero general": "AGPL"}[fields["kind"]]
        return f"{letter}-{version if '.' in version else version + '.0'}-or-later"
    if name == "CC":
        parts = fields["parts"].replace("attribution", "by").replace("noncommercial", "nc").replace("sharealike", "sa").replace("noderivatives", "nd").replace("noderivs", "nd").replace(" ", "-")
        return "CC-" + parts.upper() + (f"-{version}" if version else "")
    if name in ("LGPL", "MPL") and version:
        return f"{name}-{version if '.' in version else version + '.0'}{later}"
    return name + later


def scan(docs: DataFrame, sentences: dict[str, tuple[str, ...]] | None = None, rules=None) -> DataFrame:
    """doc_id, n_notices, licenses (sorted identifiers, comma-joined), notices array<struct<license, start, end, rule>> of every row.

    Offsets are code points, end exclusive. Null and empty texts have no notices; repeated rows stay; other columns are not looked at; an
    empty table gives an empty table. Texts are taken whole: a sentence may stand anywhere, over any number of lines within REACH. Where
    two rules fit, the earlier one takes the sentences. One Arrow batch is held at a time; nothing is shuffled.
    """

    def run(batches):
        recogniser = Recogniser(sentences, rules)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string())]))
        for batch in batches:
            found = [recogniser.notices(t.as_py() or "") for t in batch.column(1)]
            rows = [[{"license": a, "start": b, "end": c, "rule": d} for a, b, c, d in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(sorted({y[0] for y in x})) for x in found]), pa.array(rows, kind)], ["doc_id", "n_notices", "licenses", "notices"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_notices long, licenses string, notices array<struct<license:string,start:long,end:long,rule:string>>")


def op8_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices of every whole text of documents."""
    return scan(table(spark, sf_dir, "documents"))
