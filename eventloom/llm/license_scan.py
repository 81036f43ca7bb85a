"""License scans by ordered signature rules, with DataFrame functions only.

A rule is a regex with a keyword, a label and a priority. A text is searched for a license's rules only if it holds the
license's keyword and its name, which all of these rules' regexes need. Detections are intervals of code points; a detection inside
another one of the same or a higher priority is suppressed. The base labels (phrases of consecutive words) are found apart
and always stay. All of it is one projection over the scan: no shuffle, and the rules are a constant of fixed size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between words, in texts whose A-Z are not lowered yet, and within words.
SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


@dataclass(frozen=True)
class License:
    """label, its SPDX identifiers, what its name looks like as a regex, and the keyword that every name holds."""

    label: str
    spdx: tuple[str, ...]
    name: str
    keyword: str


#: Names are lower-case regexes; \s+ stands between words.
LICENSES = (
    License("mit", ("mit",), r"mit\s+license|mit(?=[.,;:)\x22]|$)", "mit"),
    License("mit-0", ("mit-0",), r"mit\s+no\s+attribution(?:\s+license)?", "attribution"),
    License("apache-2", ("apache-2.0",), r"apache(?:\s+software)?\s+license,?\s+(?:version\s+|v\.?\s*)?2(?:\.0)?", "apache"),
    License("apache-1", ("apache-1.0", "apache-1.1"), r"apache(?:\s+software)?\s+license,?\s+(?:version\s+|v\.?\s*)?1\.[01]", "apache"),
    License("gpl-1", ("gpl-1.0-only", "gpl-1.0-or-later", "gpl-1.0"), r"gnu\s+general\s+public\s+license,?\s+(?:version\s+|v\.?\s*)?1", "general"),
    License("gpl-2", ("gpl-2.0-only", "gpl-2.0-or-later", "gpl-2.0"), r"gnu\s+general\s+public\s+license,?\s+(?:version\s+|v\.?\s*)?2", "general"),
    License("gpl-3", ("gpl-3.0-only", "gpl-3.0-or-later", "gpl-3.0"), r"gnu\s+general\s+public\s+license,?\s+(?:version\s+|v\.?\s*)?3", "general"),
    License("lgpl-2", ("lgpl-2.0-only", "lgpl-2.0-or-later", "lgpl-2.1-only", "lgpl-2.1-or-later"), r"gnu\s+(?:lesser|library)\s+general\s+public\s+license,?\s+(?:version\s+|v\.?\s*)?2(?:\.[01])?", "general"),
    License("lgpl-3", ("lgpl-3.0-only", "lgpl-3.0-or-later"), r"gnu\s+lesser\s+general\s+public\s+license,?\s+(?:version\s+|v\.?\s*)?3", "lesser"),
    License("agpl-3", ("agpl-3.0-only", "agpl-3.0-or-later", "agpl-3.0"), r"gnu\s+affero\s+general\s+public\s+license,?\s+(?:version\s+|v\.?\s*)?3", "affero"),
    License("gfdl", ("gfdl-1.1-only", "gfdl-1.2-only", "gfdl-1.3-only"), r"gnu\s+free\s+documentation\s+license", "documentation"),
    License("mpl-1", ("mpl-1.0", "mpl-1.1"), r"mozilla\s+public\s+license,?\s+(?:version\s+|v\.?\s*)?1\.[01]", "mozilla"),
    License("mpl-2", ("mpl-2.0",), r"mozilla\s+public\s+license,?\s+(?:version\s+|v\.?\s*)?2(?:\.0)?", "mozilla"),
    License("epl-1", ("epl-1.0",), r"eclipse\s+public\s+license,?\s+(?:-\s+)?(?:version\s+|v\.?\s*)?1(?:\.0)?", "eclipse"),
    License("epl-2", ("epl-2.0",), r"eclipse\s+public\s+license,?\s+(?:-\s+)?(?:version\s+|v\.?\s*)?2(?:\.0)?", "eclipse"),
    License("cddl", ("cddl-1.0", "cddl-1.1"), r"common\s+development\s+and\s+distribution\s+license", "distribution"),
    License("cpl-1", ("cpl-1.0",), r"common\s+public\s+license", "common"),
    License("bsd-2", ("bsd-2-clause", "bsd-2-clause-patent"), r"(?:simplified\s+bsd|bsd[\s-]+2[\s-]+clause|2[\s-]+clause\s+bsd)(?:\s+license)?", "bsd"),
    License("bsd-3", ("bsd-3-clause", "bsd-3-clause-clear"), r"(?:(?:new|modified|revised)\s+bsd|bsd[\s-]+3[\s-]+clause|3[\s-]+clause\s+bsd)(?:\s+license)?", "bsd"),
    License("bsd-4", ("bsd-4-clause",), r"(?:original\s+bsd|bsd[\s-]+4[\s-]+clause|4[\s-]+clause\s+bsd)(?:\s+license)?", "bsd"),
    License("bsd-0", ("0bsd",), r"(?:zero[\s-]+clause\s+bsd|bsd\s+zero[\s-]+clause)(?:\s+license)?", "bsd"),
    License("isc", ("isc",), r"isc\s+license", "isc"),
    License("zlib", ("zlib",), r"zlib(?:/libpng)?\s+license", "zlib"),
    License("bsl-1", ("bsl-1.0",), r"boost\s+software\s+license", "boost"),
    License("unlicense", ("unlicense",), r"(?:the\s+)?unlicense", "unlicense"),
    License("wtfpl", ("wtfpl",), r"do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+license", "want"),
    License("artistic-1", ("artistic-1.0", "artistic-1.0-perl"), r"artistic\s+license,?\s+(?:version\s+)?1(?:\.0)?", "artistic"),
    License("artistic-2", ("artistic-2.0",), r"artistic\s+license,?\s+(?:version\s+)?2(?:\.0)?", "artistic"),
    License("psf-2", ("psf-2.0", "python-2.0"), r"python\s+software\s+foundation\s+license", "python"),
    License("ofl-1", ("ofl-1.0", "ofl-1.1"), r"(?:sil\s+)?open\s+font\s+license", "font"),
    License("osl-3", ("osl-3.0",), r"open\s+software\s+license,?\s+(?:version\s+|v\.?\s*)?3(?:\.0)?", "software"),
    License("afl-3", ("afl-3.0",), r"academic\s+free\s+license", "academic"),
    License("eupl-1", ("eupl-1.1", "eupl-1.2"), r"european\s+union\s+public\s+licen[cs]e", "european"),
    License("cecill", ("cecill-2.1", "cecill-b", "cecill-c"), r"cecill(?:-[bc])?\s+(?:free\s+software\s+)?license", "cecill"),
    License("ms-pl", ("ms-pl",), r"microsoft\s+public\s+license", "microsoft"),
    License("ms-rl", ("ms-rl",), r"microsoft\s+reciprocal\s+license", "microsoft"),
    License("ncsa", ("ncsa",), r"university\s+of\s+illinois/?(?:ncsa)?\s+open\s+source\s+license", "illinois"),
    License("postgresql", ("postgresql",), r"postgresql\s+licen[cs]e", "postgresql"),
    License("odbl-1", ("odbl-1.0",), r"open\s+(?:data\s+commons\s+open\s+)?database\s+license", "database"),
    License("odc-by-1", ("odc-by-1.0",), r"open\s+data\s+commons\s+attribution\s+license", "attribution"),
    License("pddl-1", ("pddl-1.0",), r"public\s+domain\s+dedication\s+and\s+license", "dedication"),
    License("cc0-1", ("cc0-1.0",), r"cc0(?:\s+1\.0)?", "cc0"),
    License("cc-by", ("cc-by-1.0", "cc-by-2.0", "cc-by-3.0", "cc-by-4.0"), r"cc[\s-]by(?![\s-]*(?:n|s))", "cc"),
    License("cc-by-sa", ("cc-by-sa-2.0", "cc-by-sa-3.0", "cc-by-sa-4.0"), r"cc[\s-]by[\s-]sa", "cc"),
    License("cc-by-nd", ("cc-by-nd-3.0", "cc-by-nd-4.0"), r"cc[\s-]by[\s-]nd", "cc"),
    License("cc-by-nc", ("cc-by-nc-2.0", "cc-by-nc-3.0", "cc-by-nc-4.0"), r"cc[\s-]by[\s-]nc(?![\s-]*(?:n|s))", "cc"),
    License("cc-by-nc-sa", ("cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"), r"cc[\s-]by[\s-]nc[\s-]sa", "cc"),
    License("cc-by-nc-nd", ("cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"), r"cc[\s-]by[\s-]nc[\s-]nd", "cc"),
    License("cc0-1", (), r"creative\s+commons\s+zero(?:\s+1\.0)?", "creative"),
    License("cc-by", (), r"creative\s+commons\s+attribution(?![\s-]*(?:non|share|no))", "creative"),
    License("cc-by-sa", (), r"creative\s+commons\s+attribution[\s-]+share\s*-?alike", "creative"),
    License("cc-by-nd", (), r"creative\s+commons\s+attribution[\s-]+no\s*-?deriv\w*", "creative"),
    License("cc-by-nc", (), r"creative\s+commons\s+attribution[\s-]+non\s*-?commercial(?![\s-]*(?:share|no))", "creative"),
    License("cc-by-nc-sa", (), r"creative\s+commons\s+attribution[\s-]+non\s*-?commercial[\s-]+share\s*-?alike", "creative"),
    License("cc-by-nc-nd", (), r"creative\s+commons\s+attribution[\s-]+non\s*-?commercial[\s-]+no\s*-?deriv\w*", "creative"),
    License("proprietary", (), r"all\s+rights\s+reserved", "reserved"),
)

#: How a name is met, from the strongest: priority, what every match of the form holds besides the name, and the regex around
#: {name}. Before the name stands a space, a sign or nothing, after it a space or nothing.
FORMS = (
    (90, "under", r"(?:is\s+|are\s+)?(?:licen[cs]ed|released|distributed|published|available|redistributable)\s+under\s+(?:the\s+terms\s+of\s+)?(?:the\s+)?{name}(?:\s+licen[cs]e)?"),
    (80, "", r"(?:subject\s+to|governed\s+by|according\s+to|covered\s+by)\s+(?:the\s+terms\s+of\s+)?(?:the\s+)?{name}"),
    (70, "licen", r"licen[cs]e\s*[:=]\s*(?:the\s+)?{name}"),
    (60, "under", r"under\s+(?:the\s+terms\s+of\s+)?(?:the\s+)?{name}"),
    (40, "", r"(?:the\s+)?{name}"),
)
#: Between the words of a signature.
BETWEEN = r"[^a-z0-9]+"
#: The bare name says too little here.
BARE_TOO_SHORT = frozenset({"mit"})
#: What license texts and notices say, also without a name: label, priority, the rarest of its words, and the words. Between
#: words may stand space, punctuation and the signs of comments; {n} is any word.
SIGNATURES = (
    ("mit", 55, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 50, "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 45, "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", 55, "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", 55, "hereby", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-0", 50, "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd-2", 45, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2", 44, "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2", 44, "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-2", 43, "contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-3", 55, "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", 55, "advertising", "all advertising materials mentioning features or use of this software must display the following"),
    ("apache-2", 60, "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", 45, "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2", 45, "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 50, "reproduction", "terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-2", 50, "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1", 50, "acknowledgment", "the end user documentation included with the redistribution if any must include the following acknowledgment"),
    ("gpl-2", 85, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3", 85, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", 50, "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", 50, "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", 50, "freedom", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("lgpl-2", 85, "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2"),
    ("lgpl-2", 85, "redistribute", "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2"),
    ("lgpl-3", 85, "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3", 85, "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3", 50, "cooperation", "specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", 85, "invariant", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version {n} {n} or any later version published by the free software foundation with no invariant sections"),
    ("mpl-2", 85, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 50, "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1", 85, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", 85, "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", 85, "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl", 85, "contents", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsl-1", 60, "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", 55, "arising", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 55, "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", 60, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 50, "compile", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 60, "want", "you just do what the {n} you want to"),
    ("cc0-1", 50, "waiving", "dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("ofl-1", 60, "typefaces", "no copy of one or more of the font software typefaces may be sold by itself"),
    ("ofl-1", 60, "font", "this font software is licensed under the sil open font license version 1 1"),
    ("artistic-2", 55, "package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-1", 55, "semblance", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("psf-2", 60, "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce"),
    ("postgresql", 60, "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ms-pl", 55, "governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("eupl-1", 60, "eupl", "licensed under the eupl"),
    ("proprietary", 40, "confidential", "this software is the confidential and proprietary information of"),
    ("proprietary", 40, "retrieval", "no part of this publication may be reproduced stored in a retrieval system or transmitted"),
    ("proprietary", 40, "prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
)
#: What stands for the name in SPDX tags.
TAG = "spdx-license-identifier"


def edge(regex: str) -> str:
    return rf"(?<![a-z0-9])(?:{regex})(?![a-z0-9])"


def rules() -> list[tuple[str, str, str, str, int, str]]:
    """(keyword, second keyword, regex over texts lowered in A-Z, label, priority, name), the strongest first: forms by license,
    SPDX tags and signatures of license texts, whose names are they themselves. A form without a word of its own has the name's keyword twice. No regex matches a text without both
    keywords and a match of name."""
    out = []
    for x in LICENSES:
        for priority, word, form in FORMS:
            if x.label == "proprietary" and priority != 40 or x.label in BARE_TOO_SHORT and priority == 40:
                continue
            out.append((x.keyword, word or x.keyword, edge(form.format(name=f"(?:{x.name})")), x.label, priority, edge(x.name)))
        for spdx in x.spdx:
            out.append((TAG, spdx, edge(TAG + r"\s*:\s*" + spdx.replace(".", r"\.")), x.label, 100, TAG))
    for label, priority, word, words in SIGNATURES:
        regex = edge(BETWEEN.join(r"\w+" if w == "{n}" else w for w in words.split()))
        out.append((word, word, regex, label, priority, regex))
    return sorted(out, key=lambda r: -r[4])


def words_in(text: Column) -> Column:
    """Number of words: matches of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are lowered."""
    ends = F.substring(text, 1, 1).rlike(SEP).cast("int") + F.substring(text, -1, 1).rlike(SEP).cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, SEP + "+")) - ends)


def phrase_starts(text: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively."""
    regex = rf"(?i)(?<!{WORD})" + (SEP + "+").join(phrase.split()) + rf"(?!{WORD})"
    n = len(phrase.split())
    gaps = F.split(text, regex, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))
    step = lambda acc, gap: F.struct((acc["at"] + words_in(gap) + n).alias("at"), F.concat(acc["all"], F.array(acc["at"] + words_in(gap))).alias("all"))
    found = F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), start, step, lambda acc: acc["all"])
    return F.when(text.rlike(regex), found).otherwise(F.expr("cast(array() as array<int>)"))


def lowered(text: Column) -> Column:
    """text with A-Z lowered and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def detections(text: Column) -> Column:
    """All rules' matches in text: array<struct<s, e, label, priority>>; text is lowered in A-Z."""
    by_key: dict[str, dict[str, list[dict]]] = {}
    for k, f, r, label, priority, name in rules():
        by_key.setdefault(k, {}).setdefault(name, []).append({"f": f, "r": r, "l": label, "p": priority})
    listed = json.dumps([{"k": k, "n": [{"n": n, "r": r} for n, r in names.items()]} for k, names in by_key.items()])
    constant = F.from_json(F.lit(listed), "array<struct<k:string,n:array<struct<n:string,r:array<struct<f:string,r:string,l:string,p:int>>>>>>")  # folded when planned
    names = F.flatten(F.transform(F.filter(constant, lambda x: F.contains(text, x["k"])), lambda x: F.filter(x["n"], lambda n: F.rlike(text, n["n"]))))
    held = F.filter(F.flatten(F.transform(names, lambda n: n["r"])), lambda x: F.contains(text, x["f"]))

    def of(rule: Column) -> Column:
        gaps, hits = F.split(text, rule["r"], -1), F.regexp_extract_all(text, rule["r"], F.lit(0))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,label:string,priority:int>>)").alias("all"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.length(x["gap"])
            e = s + F.length(x["hit"])
            return F.struct(e.alias("at"), F.concat(acc["all"], F.array(F.struct(s.alias("s"), e.alias("e"), rule["l"].alias("label"), rule["p"].alias("priority")))).alias("all"))

        pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        return F.aggregate(pairs, start, step, lambda acc: acc["all"])

    return F.flatten(F.transform(F.filter(held, lambda rule: F.rlike(text, rule["r"])), of))


def standing(found: Column) -> Column:
    """Detections that no other one holds: a longer one of the same or a higher priority, or an equal one before it."""

    def beaten(d: Column) -> Column:
        inside = lambda o: (o["s"] <= d["s"]) & (o["e"] >= d["e"])
        longer = lambda o: (o["e"] - o["s"]) > (d["e"] - d["s"])
        first = lambda o: (o["priority"] > d["priority"]) | ((o["priority"] == d["priority"]) & (o["label"] < d["label"]))
        return F.exists(found, lambda o: inside(o) & F.when(longer(o), o["priority"] >= d["priority"]).otherwise(first(o)))

    return F.filter(found, lambda d: ~beaten(d))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, found: one row per input row.

    found holds the detections that stand: start and end in code points, label, priority. Null text counts as empty; texts
    without words or detections have zero counts, null word numbers, empty labels and no detections. Rows repeated are rows
    of their own; empty tables give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # as an element of an array, so that the text is lowered once and not once for every rule
    raw = F.element_at(F.transform(F.array(lowered(text)), detections), 1)
    got = docs.select("doc_id", words_in(text).cast("long").alias("n_words"), F.array(*[phrase_starts(text, p) for p, _ in PHRASES]).alias("base"), raw.alias("raw"))
    starts = F.flatten("base")
    labels = F.filter(F.transform("base", lambda x, i: F.when(F.size(x) > 0, F.element_at(F.array(*[F.lit(v) for _, v in PHRASES]), i + 1))), lambda v: v.isNotNull())
    return got.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), labels.alias("base_labels"), standing(F.col("raw")).alias("found"),
    )


def license_labels(docs: DataFrame) -> DataFrame:
    """scan() as labels: base_labels and labels comma-joined, and score, the best standing detection's priority by 100."""
    found = scan(docs)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda d: d["priority"])), F.when(F.col("n_base") > 0, 60).otherwise(0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", F.transform("found", lambda d: d["label"]))).alias("labels"), (best / F.lit(100.0)).alias("score"),
    )
