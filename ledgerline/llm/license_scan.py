"""License scans by conditional compression.

Texts with a licensing word become candidates (a JVM-side filter); around
each such word a block of words is cut out. A block is compressed alone and
with every template as a zstandard raw dictionary: the closer the wording,
the larger the reduction. Templates are ranked by the bytes that they save
(in a repetitive block, which shrinks without any template, the better of
the block and its distinct words); one that saves none is no candidate. A
candidate is confirmed by its exact
wording: the alignment of the template's words with the block's (missing,
added and replaced words) must differ in at most ``MAX_DIFFERENCE`` of the
template's words, none for short ones. The differing words are part of the
result. A number never stands for another one.

Templates hold slots for what varies (years, holder, version, identifier).
Where confirmed matches overlap, the one that saves most wins; those within
``MARGIN`` bytes of it are equal to a compressor (a slot saves nothing), so
among them the one with more words of its template in place wins, less one
for each difference.

Work is per row, without a shuffle; a block has a bounded number of words,
so very long texts are many blocks.

Defined results: null, empty and unlicensed texts give no row; repeated rows
give their rows each. A license named without its version is reported without
one; a wording of no template gives no row. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIFFERENCE = 0.1
MARGIN = 4
LEVEL = 6
# Stands before every block, alone or not: a few words by themselves are stored as they are, whatever the dictionary.
LEAD = b"0123456789 0123456789 0123456789 "
NEVER = 1_000_000

# Words that nominate a block, and public license notices.
CUE = r"(?i)licen[cs]|copyright|redistribut|rights reserved|creative commons|public domain|free of charge" \
      r"|hereby granted|\b[AL]?GPL|\bCC[ -](?:BY|0)|\bCC0\b"
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "Copyright. All rights reserved."),
    ("proprietary", "All rights reserved."),
)

# Slots: up to so many words of a form, at no cost. A word /form/ is one required word; ``{}`` in a name is its text.
SLOTS = {"{year}": (3, r"c|©|copyright|present|(?:19|20)\d\d(?:[-–,/](?:\d\d|\d{4}|present))*"),
         "{holder}": (8, r"(?!licens|under$|released$|permission$)[^\0]+"), "{v}": (2, r"v|version|[-–]"), "{the}": (1, r"the|an?"),
         "{kind}": (1, r"international|unported|generic|universal"), "{license}": (1, r"license")}
USUAL = {"{the}": "the", "{license}": "license", "{v}": "version", "{kind}": "international", "{year}": "copyright"}
VERSION = r"/v?\d+(?:\.\d+)*\+?/"
FORMS = ("under {the} %s", "under the terms of {the} %s", "This work is licensed under {the} %s",
         "subject to the terms of {the} %s", "License: {the} %s", "%s Copyright {year}")


def _named() -> list[tuple[str, str]]:
    """(name, template): the forms in which a notice names a license of the common SPDX list."""
    named = [("MIT", "MIT {license}"), ("MIT", "Expat {license}"), ("ISC", "ISC {license}"), ("Zlib", "zlib license"),
             ("BSD", "BSD {license}"), ("Unlicense", "Unlicense"), ("WTFPL", "WTFPL"), ("CC0-1.0", "CC0 {license}"),
             ("Apache", "Apache License"), ("Apache", "Apache Software License"),
             ("Apache-2.0", "Apache-2.0 {license}"), ("Apache-2.0", "Apache {license} {v} /v?2(?:\\.0)?/ {license}"),
             ("Apache-1.1", "Apache {license} {v} /v?1\\.1/ {license}"),
             ("CC0-1.0", "CC0 {v} /v?1(?:\\.0)?/ {kind}"), ("CC0-1.0", "CC0-1.0"), ("CC0-1.0", "Creative Commons Zero {license}"),
             ("BSD-2-Clause", "Simplified BSD {license}"), ("BSD-3-Clause", "New BSD {license}"),
             ("BSD-3-Clause", "Modified BSD {license}"), ("0BSD", "Zero-Clause BSD {license}"), ("0BSD", "0BSD {license}")]
    for n in "234":
        named += [(f"BSD-{n}-Clause", x) for x in (f"BSD {n}-Clause {{license}}", f"{n}-Clause BSD {{license}}",
                                                   f"BSD-{n}-Clause {{license}}", f"BSD {n} Clause {{license}}")]
    for key, full in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"),
                      ("LGPL", "GNU Library General Public License"), ("AGPL", "GNU Affero General Public License"),
                      ("GFDL", "GNU Free Documentation License"), ("MPL", "Mozilla Public License"),
                      ("EPL", "Eclipse Public License"), ("EUPL", "European Union Public License"), ("BSL", "Boost Software License"),
                      ("Artistic", "Artistic License"), ("CDDL", "Common Development and Distribution License"),
                      ("GPL", "GNU GPL"), ("LGPL", "GNU LGPL"), ("AGPL", "GNU AGPL"), *((x, x) for x in (
                          "GPL", "LGPL", "AGPL", "MPL", "EPL", "EUPL", "CDDL"))):
        named += [(key, full), (f"{key}-{{}}", f"{full} {{v}} {VERSION} {{license}}")]
        if full == key:
            named.append((f"{key}-{{}}", f"/{key.lower()}-?v?\\d+(?:\\.\\d+)*\\+?/ {{license}}"))
    for short, full in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                        ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for x in (f"CC {short}", f"CC-{short}", f"Creative Commons {short}", f"Creative Commons {full}"):
            named += [(f"CC-{short}", f"{x} {{license}}"), (f"CC-{short}-{{}}", f"{x} {{license}} {VERSION} {{kind}} {{license}}")]
        named.append((f"CC-{short}-{{}}", f"/cc-{short.lower()}-\\d+(?:\\.\\d+)*/ {{license}}"))
    return [(k, f % x) for k, x in named for f in FORMS]


# Everything that is looked for: the notices above, with slots, and the opening words of common licenses.
NOTICES = TEMPLATES + (
    ("proprietary", "Copyright {year} {holder} All rights reserved."),
    ("proprietary", "© {year} {holder} All rights reserved."),
    ("proprietary", "All rights reserved {year} {holder} Copyright"),
    *(("{}", "SPDX-License-Identifier: " + " /or|and|with/ ".join([r"/\(*[a-z0-9][\w.+-]*/"] * n)) for n in (1, 2, 3, 4)),
    ("MIT", "The MIT License MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "placed in the public domain"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    *((f"{key}-{{}}", f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {full} "
                      f"as published by the Free Software Foundation, either {{v}} {VERSION} of the License")
      for key, full in (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"),
                        ("LGPL", "Library General Public License"), ("AGPL", "Affero General Public License"))
      for what in ("program", "library", "file")),
    *_named(),
)

WORD = re.compile(r"\S+")


def plain(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}<>*#").replace("licence", "license")


def winners(matches: list[tuple]) -> list[tuple]:
    """Disjoint ones of the confirmed ``matches`` (bytes saved, differences less words in place, template, start, end, ...).

    The match that saves most leads; among those that overlap it and save nearly as much, the wording decides.
    """
    out, left = [], sorted(matches, key=lambda m: (-m[0], *m[1:5]))
    while left:
        lead = left[0]
        best = min((m for m in left if m[0] >= lead[0] - MARGIN and m[3] < lead[4] and lead[3] < m[4]),
                   key=lambda m: (m[1], -m[0], *m[2:5]))
        out.append(best)
        left = [m for m in left if m[4] <= best[3] or best[4] <= m[3]]
    return out


class Slot:
    """A word of a template given by its form: an optional one (a missing word costs nothing) or a required one."""

    def __init__(self, form: str, required: bool, usual: str = ""):
        self.fits, self.required = re.compile(form).fullmatch, required
        self.wild = bool(self.fits("\1"))
        # what stands for it in a dictionary: its usual word, or the letters that it begins with
        self.usual = usual or (re.match(r"[a-z]*", form).group() if required and "|" not in form else "")


def read(template: str) -> list[str | Slot]:
    """A template's words and slots."""
    out: list[str | Slot] = []
    for w in template.split():
        if w in SLOTS:
            n, form = SLOTS[w]
            out += [Slot(form, False, USUAL.get(w, "")), *[Slot(form, False)] * (n - 1)]
        elif w[0] == w[-1] == "/" and len(w) > 2:
            out.append(Slot(w[1:-1], True))
        elif plain(w):
            out.append(plain(w))
    return out


def _numeric(word: str) -> bool:
    return word[:1].isdigit() or word[:1] == "v" and word[1:2].isdigit()


def _cost(t: str | Slot, word: str) -> int:
    """Differences of a template's word against a word of the block."""
    if isinstance(t, Slot):
        return 0 if t.fits(word) else NEVER
    return 0 if t == word else NEVER if _numeric(t) and _numeric(word) else 1


def _missing(t: str | Slot) -> int:
    """Differences of a template's word against nothing."""
    if isinstance(t, Slot):
        return NEVER if t.required else 0
    return NEVER if _numeric(t) else 1


def aligned(template: list[str | Slot], block: list[str]) -> tuple[int, int, int, list[str], list[tuple[Slot, int]]]:
    """``align`` and the slots that hold a word, with its place."""
    n = len(block)
    rows = [[0] * (n + 1)]
    for t in template:
        gap = _missing(t)
        prev, row = rows[-1], [rows[-1][0] + gap]
        for j in range(n):
            row.append(min(prev[j] + _cost(t, block[j]), prev[j + 1] + gap, row[j] + 1))
        rows.append(row)
    end = j = min(range(n + 1), key=lambda x: (rows[-1][x], x))
    # optional words at the end belong to the match
    tail = len(template)
    while tail and isinstance(template[tail - 1], Slot) and not template[tail - 1].required:
        tail -= 1
    for t in template[tail:]:
        if end < n and rows[-1][end + 1] == rows[-1][end] and t.fits(block[end]):
            end += 1
    i, j, notes, held = len(template), end, [], []
    while i:
        t = template[i - 1]
        if j and rows[i][j] == rows[i - 1][j - 1] + _cost(t, block[j - 1]):
            i, j = i - 1, j - 1
            if isinstance(t, Slot):
                held.append((t, j))
            elif t != block[j]:
                notes.append(f"{t} -> {block[j]}")
        elif rows[i][j] == rows[i - 1][j] + _missing(t):
            i -= 1
            if not isinstance(t, Slot):
                notes.append(f"- {t}")
        else:
            j -= 1
            notes.append(f"+ {block[j]}")
    return rows[-1][end], j, end, notes[::-1], held[::-1]


def align(template: list[str | Slot], block: list[str]) -> tuple[int, int, int, list[str]]:
    """Best stretch of ``block`` for the whole template: (differences, start, end, wording differences).

    Word edit distance with free ends in the block; among equal distances the first stretch that ends earliest.
    """
    return aligned(template, block)[:4]


def wording(template: list[str | Slot]) -> str:
    """A template as a dictionary: its words, and of its slots what usually stands there."""
    return " ".join(w if isinstance(w, str) else w.usual for w in template if isinstance(w, str) or w.usual)


class Scanner:
    """Dictionaries for a set of templates, made once in each Python worker when first needed."""

    def __init__(self, templates=NOTICES):
        self.templates = []
        for name, text in templates:
            t = read(text)
            fixed = [w for w in t if isinstance(w, str)]
            self.templates.append((name, t, fixed, len(t) - sum(isinstance(w, Slot) and not w.required for w in t)))
        # templates that differ in slots only share a dictionary
        kinds: dict[str, int] = {}
        self.kind = [kinds.setdefault(wording(t), len(kinds)) for _, t, _, _ in self.templates]
        self.kinds = list(kinds)
        self.reach = max(len(t) for _, t, _, _ in self.templates)
        self.made: list = []

    def sizes(self, raw: bytes) -> tuple[int, list[int]]:
        """Compressed bytes of ``raw`` alone, and with each dictionary."""
        import zstandard as z

        if not self.made:
            params = z.ZstdCompressionParameters.from_level(
                LEVEL, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            self.made = [z.ZstdCompressor(compression_params=params)]
            for text in self.kinds:
                d = z.ZstdCompressionDict(text.encode().ljust(8), dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self.made.append(z.ZstdCompressor(compression_params=params, dict_data=d))
        alone, *given = [len(c.compress(LEAD + raw)) for c in self.made]
        return alone, given

    def savings(self, body: list[str]) -> tuple[int, list[int]]:
        """Compressed bytes of a block, and the bytes that each dictionary saves."""
        alone, given = self.sizes(" ".join(body).encode("utf-8", "surrogatepass"))
        saved = [alone - x for x in given]
        once = dict.fromkeys(body)
        if 2 * len(once) < len(body):
            least, given = self.sizes(" ".join(once).encode("utf-8", "surrogatepass"))
            saved = [max(x, least - y) for x, y in zip(saved, given)]
        return alone, saved

    def blocks(self, words: list[str], cues: list[int]) -> Iterator[tuple[int, int]]:
        """Stretches of words around the cues, joined where they overlap and cut where they get long."""
        r = self.reach
        spans: list[list[int]] = []
        for c in cues:
            a, b = max(0, c - r), min(len(words), c + r + 1)
            if spans and a <= spans[-1][1] and b - spans[-1][0] <= 8 * r:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        return ((a, b) for a, b in spans)

    def scan(self, text: str) -> list[tuple[str, int, int, float, int, list[str], str]]:
        """(license, first word, words, reduction, differences, wording differences, matched text) in order."""
        places = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [plain(text[a:b]) for a, b in places]
        starts = [a for a, _ in places]
        from bisect import bisect_right
        cues = sorted({bisect_right(starts, m.start()) - 1 for m in re.finditer(CUE, text)})
        found: dict[tuple[int, int], tuple] = {}
        for a, b in self.blocks(words, [c for c in cues if c >= 0]):
            body = words[a:b]
            base, by_kind = self.savings(body)
            present, matches = set(body), []
            saves = [by_kind[x] for x in self.kind]
            for k in sorted(range(len(saves)), key=lambda x: (-saves[x], x)):
                name, template, fixed, n = self.templates[k]
                if saves[k] <= 0:
                    break
                allowed = MAX_DIFFERENCE * n
                # each absent word is a difference at least
                if sum(w not in present for w in fixed) > allowed:
                    continue
                rest = body
                while True:
                    diff, i, j, notes, held = aligned(template, rest)
                    if diff > allowed or i == j or "\0" in rest[i:j]:
                        break
                    rest = rest[:i] + ["\0"] * (j - i) + rest[j:]
                    ids = [places[a + x] for t, x in held if t.required]
                    # the operators of an SPDX expression are capitals
                    if name == "{}" and not all(text[x:y].isupper() for x, y in ids[1::2]):
                        continue
                    given = text[ids[0][0]:ids[-1][1]].strip("()*/<>,;.") if ids else ""
                    if name != "{}":
                        given = plain(given)
                        given = re.sub(r"^[a-z-]+", "", given).rstrip("+")
                        given += ".0" * (given.isdigit() and not name.startswith("CC0"))
                    # words in place; a holder's words count for nothing
                    n_held = n + sum(not (t.required or t.wild) for t, _ in held)
                    matches.append((saves[k], diff - n_held, k, a + i, a + j, diff, notes, name.replace("{}", given)))
            for saved, _, _, s, e, diff, notes, name in winners(matches):
                found.setdefault((s, e), (name, s, e - s, saved / base, diff, notes, text[places[s][0]:places[e - 1][1]]))
        out, last = [], -1
        for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
            if s >= last:
                out.append(found[s, e])
                last = e
        return out


def scan(docs: DataFrame, templates=NOTICES) -> DataFrame:
    """(doc_id, license, position, n_words, reduction, n_differences, differences, matched): one row per notice found."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.where(F.col("text").rlike(CUE)).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            ids, rows = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in scanner.scan(t):
                    ids.append(d)
                    rows.append(r)
            cols = list(zip(*rows)) if rows else [()] * 7
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), *(pa.array(list(c), t) for c, t in zip(cols, types))],
                names=["doc_id", "license", "position", "n_words", "reduction", "n_differences", "differences", "matched"])

    return src.mapInArrow(run, f"doc_id {kind}, license string, position bigint, n_words bigint, reduction double, "
                               "n_differences bigint, differences array<string>, matched string")
