"""Licence scans by sentence rules, in DataFrame operations only.

A text is cut into sentences at line breaks and after . ! ? ; before white space.  Sentences are normalised (ASCII lower case,
other characters than letters, digits, . and + are one space) and mapped to the identifiers of known licence sentences.  A
known sentence may be wrapped: from each line that one can begin with, runs of neighbouring lines up to the longest known sentence
are looked up too; a blank line or a sentence's end parts them, and lines inside a wrapped sentence count for nothing else.  The
sequence of a text's identifiers is matched against ordered rules: a rule holds if its identifiers occur in its order.

Texts without any of the words that each known sentence has one of are passed over before they are cut; this loses nothing.

Comment marks (//, #, *, ;, !, --, <!-- and the like) count as spaces, and so do quotation marks and brackets.

Defined results: null and empty texts, and texts without a known sentence, give no row; a text with known sentences that complete
no rule gives a row with an empty list of licences; rules that hold on the same sentences are all listed, in the rules' order; very
long texts are scanned whole; repeated rows give equal rows; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER

#: licences that have an SPDX line and common notices (fixed values): identifier -> names that stand in "Licensed under the ..."
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License", "MIT license (MIT)", "terms of the MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD license"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal license", "Creative Commons Zero v1.0 Universal license"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
#: what stands before such a name in a notice
NOTICES = [
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This project is licensed under the {}", "This software is licensed under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This program is licensed under the {}", "This is licensed under the {}", "This file is licensed under the {}",
    "This code is licensed under the {}", "This code is released under the {}", "This document is licensed under {}", "This text is licensed under {}", "Available under the {}",
    "The source code is licensed under the {}", "This project is released under the {}", "License: {}", "Licence: {}",
]
#: identifier -> sentences that stand for it, as the licences have them (fixed values); a sentence ends at a stop before white space, also in "v. 2.0"
TEXTS = {
    "apache-2.0-notice": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-2.0-compliance": ["you may not use this file except in compliance with the License."],
    "apache-2.0-copy": ["You may obtain a copy of the License at"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2-free": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    ],
    "gpl-2-later": ["either version 2 of the License, or (at your option) any later version."],
    "gpl-warranty": ["See the GNU General Public License for more details."],
    "lgpl-3-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-2.1-free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "lgpl-2.1-later": ["either version 2.1 of the License, or (at your option) any later version."],
    "agpl-3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl-2.0-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "epl-2.0-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-no-endorsement": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain."],
    "wtfpl-name": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "cc0-waiver": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
}
SENTENCES = {
    **{f"{i.lower()}-notice": [n.format(x) for x in names for n in NOTICES] for i, names in NAMES.items()},
    **{f"{i.lower()}-spdx": [f"SPDX-License-Identifier: {i}{end}" for end in ("", "-only", "-or-later")] for i in NAMES},
}
for _id, _own in TEXTS.items():
    SENTENCES[_id] = SENTENCES.get(_id, []) + [x for x in _own if x not in SENTENCES.get(_id, [])]
#: licence -> ordered identifiers
RULES = [
    *((i, [f"{i.lower()}-notice"]) for i in NAMES),
    *((i, [f"{i.lower()}-spdx"]) for i in NAMES),
    ("Apache-2.0-header", ["apache-2.0-notice", "apache-2.0-compliance", "apache-2.0-copy"]),
    ("MIT-text", ["mit-condition", "as-is"]),
    ("MIT-grant", ["mit-grant", "mit-condition"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl-2-free", "gpl-2-later"]),
    ("LGPL-3.0-or-later", ["lgpl-3-free"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-free", "lgpl-2.1-later"]),
    ("AGPL-3.0-or-later", ["agpl-3-free"]),
    ("MPL-2.0-header", ["mpl-2.0-notice"]),
    ("BSD-2-Clause-text", ["bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-no-endorsement"]),
    ("ISC-text", ["isc-grant"]),
    ("Zlib-text", ["zlib-warranty", "zlib-grant"]),
    ("Unlicense-text", ["unlicense-domain"]),
    ("WTFPL-text", ["wtfpl-name"]),
    ("CC0-1.0-waiver", ["cc0-waiver"]),
]
#: each known sentence has one of these
WORDS = ["licen", "permission", "warrant", "redistribut", "copyright", "public domain", "released under", "distributed under", "available under"]


def _plain(text: str) -> str:
    """The normal form of one sentence, for the table of known ones."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return " ".join("".join(c if c.isascii() and (c.isalnum() or c in ".+") else " " for c in low).split()).rstrip(".").rstrip()


def known_sentences(sentences: dict[str, list[str]] = SENTENCES) -> dict[str, str]:
    known = {_plain(s): i for i, all_of_it in sentences.items() for s in all_of_it}
    missed = [s for s in known if not any(w in s for w in WORDS)]
    if missed:
        raise ValueError(f"these sentences have none of the words that texts are chosen by: {missed}")
    return known


def beginnings(known: dict[str, str]) -> list[str]:
    """What the first line of a known sentence may be, however it is wrapped."""
    return sorted({" ".join(w[:n]).rstrip(". ") for w in (s.split() for s in known) for n in range(1, len(w) + 1)})


def _normal(sentence: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(sentence, "[^a-z0-9.+]+", " ")), r"[. ]+$", "")


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    """doc_id and the columns, made once: a generator's output is not written into later expressions, where it would be made again for each line."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select("doc_id", one).select("doc_id", *[f"_made.{n}" for n in columns])


def scan(docs: DataFrame, sentences: dict[str, list[str]] = SENTENCES, rules=RULES) -> DataFrame:
    """(doc_id, sentence_ids, first_sentence, licenses) of rows with a known sentence: its identifiers in order, the number of the first, the rules that hold."""
    known = known_sentences(sentences)
    whole, begin = sorted(known), beginnings(known)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(known.items()))])
    low = F.translate("text", UPPER, LOWER)
    some = docs.select("doc_id", low.alias("low")).where(reduce(or_, [F.col("low").contains(w) for w in WORDS]))
    cut = some.select("doc_id", F.split(F.regexp_replace(F.regexp_replace("low", r"(?m)^[\x20\x09]*[;!]+", ""), r"([.!?;])[\x20\x09\x0B-\x0D]+", "$1\n"), "\n").alias("cut"))
    cut = _made(cut, line=F.transform("cut", _normal), ends=F.transform("cut", lambda s: s.rlike(r"[.!?;]$")))
    # a sentence stands in a line, or begins in one and goes on in the next: both are looked up in hashed sets
    places = F.transform("line", lambda s, i: F.struct(s.alias("line"), i.alias("i")))
    goes_on = lambda x: ~F.get("ends", x["i"]) & F.coalesce(F.get("line", x["i"] + 1) != "", F.lit(False)) & F.concat_ws(" ", x["line"], F.get("line", x["i"] + 1)).isin(begin)
    begun = F.transform(F.filter(places, lambda x: x["line"].isin(whole) | (x["line"].isin(begin) & goes_on(x))), lambda x: F.struct((x["i"] + 1).alias("at")))
    cut = _made(cut, line=F.col("line"), ends=F.col("ends"), begun=begun).where(F.size("begun") > 0)
    longest = max(len(s.split()) for s in known)

    def run(at: Column, n: Column) -> Column:
        """The identifier of ``n`` neighbouring lines from ``at`` on; none across a blank line or a sentence's end."""
        lines = F.slice("line", at, n)
        text = F.array_join(lines, " ")
        parted = F.array_contains(lines, "") | F.array_contains(F.slice("ends", at, n - 1), True)
        return F.struct(n.alias("n"), F.when(text.isin(whole) & ~parted, F.try_element_at(table, text)).alias("id"))

    def first(x: Column) -> Column:
        runs = F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("line") - x["at"] + 1)), lambda n: run(x["at"], n)), lambda r: r["id"].isNotNull())
        return F.struct(x["at"].alias("at"), F.get(runs, F.lit(0))["n"].alias("n"), F.get(runs, F.lit(0))["id"].alias("id"))

    cut = _made(cut, hit=F.filter(F.transform("begun", first), lambda x: x["id"].isNotNull()))
    cut = cut.select("doc_id", "hit", F.filter("hit", lambda x: x["n"] > 1).alias("wrapped"))
    at = F.filter("hit", lambda x: ~F.exists("wrapped", lambda w: (w["at"] < x["at"]) & (x["at"] < w["at"] + w["n"])))
    found = _made(cut, at=at).where(F.size("at") > 0).select("doc_id", F.array_join("at.id", " ").alias("sentence_ids"), F.get("at", F.lit(0))["at"].cast("long").alias("first_sentence"))
    padded = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    hits = [F.when(padded.rlike(pattern(*ids)), F.lit(name)) for name, *ids in _by_name(rules)]
    return found.withColumn("licenses", F.array_join(F.filter(F.array(*hits), lambda x: x.isNotNull()), " "))


def _by_name(rules) -> list[tuple]:
    """(name, identifiers, identifiers, ...): the ways in which each licence is told, in the order of names."""
    ways: dict[str, list] = {}
    for name, ids in rules:
        ways.setdefault(name, []).append(ids)
    return [(name, *own) for name, own in ways.items()]


def pattern(*ways: list[str]) -> str:
    """A regular expression for identifiers that follow each other, others between them allowed, in any of the ways."""
    return "|".join(" " + " (?:.* )?".join(i.replace(".", "[.]").replace("+", "[+]") for i in ids) + " " for ids in ways)
