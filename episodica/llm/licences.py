"""Licence scan by sentence rules: known sentences become identifiers, identifier sequences meet ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of public licence notices.
SENTENCES = {
    "mit_name": ["Released under the MIT License", "Licensed under the MIT License", "The MIT License", "MIT License"],
    "mit_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "apache2_name": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "apache2_copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache2_as_is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "gpl3_name": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3"],
    "gpl_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd_warranty": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "mpl2_name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "cc_by_nc4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc_by4": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc_by_sa4": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["Licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl2_free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl2_name": ["Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2"],
    "lgpl21_free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3_free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "bsl_grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "epl2_name": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"],
    "zlib_as_is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "bsd3_name": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", "BSD 3-Clause License"],
    "bsd2_name": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "BSD 2-Clause License"],
    "reserved": ["All rights reserved"],
    # Titles of whole licence texts.
    "apache2_text": ["Apache License Version 2.0, January 2004"],
    "gpl3_text": ["GNU General Public License Version 3, 29 June 2007"],
    "gpl2_text": ["GNU General Public License Version 2, June 1991"],
    "lgpl3_text": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "lgpl21_text": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "agpl3_text": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "mpl2_text": ["Mozilla Public License Version 2.0"],
    "epl2_text": ["Eclipse Public License - v 2.0"],
    "cc0_text": ["CC0 1.0 Universal"],
    "bsl_text": ["Boost Software License - Version 1.0 - August 17th, 2003"],
}
# Names that follow `under the`, as normal words.
CALLED = {
    "mit_name": "mit license",
    "apache2_name": "apache license version 2 0|apache license 2 0|apache 2 0 license",
    "gpl3_name": "gnu general public license version 3|gnu gpl version 3",
    "gpl2_name": "gnu general public license version 2|gnu gpl version 2",
    "mpl2_name": "mozilla public license version 2 0|mozilla public license 2 0",
    "bsd3_name": "bsd 3 clause license|3 clause bsd license",
    "bsd2_name": "bsd 2 clause license|2 clause bsd license",
}
# Notices with parts that vary, as normal words; <N> stands for 1 to N words. The first that fits a sentence names it.
VARIED = [
    ("bsd_endorse", "neither the name of <12> nor the names of <4> contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd_endorse", "the names? of <12> may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd_warranty", "this software is provided by <12> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd_style", "use of this source code is governed by a bsd style license(?: that can be found in <8>)?"),
    *((k, f"(?:<6> (?:is|are) )?(?:released|licensed|distributed|available) under (?:the terms of )?(?:the )?(?:{v})(?: (?:please )?(?:see|found in|as found in) <10>)?") for k, v in CALLED.items()),
]
# Short names of licences that a tag may give.
TAGGED = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "ISC", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
TAG = "SPDX-License-Identifier:"
# Older short names.
SHORT = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
SENTENCES |= {f"tag_{x}": [f"{TAG} {y}" for y in (x, *(k for k, v in SHORT.items() if v == x))] for x in TAGGED}
# Ordered rules: a rule fits where its identifiers follow each other; the first rule that fits names the licence.
RULES = [
    *((x, [f"tag_{x}"]) for x in TAGGED),
    ("Apache-2.0", ["apache2_name", "apache2_copy", "apache2_as_is"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("GPL-3.0-only", ["gpl3_text"]),
    ("GPL-2.0-only", ["gpl2_text"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("AGPL-3.0-only", ["agpl3_text"]),
    ("LGPL-3.0-only", ["lgpl3_text"]),
    ("LGPL-2.1-only", ["lgpl21_text"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_endorse", "bsd_warranty"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_warranty"]),
    ("AGPL-3.0-or-later", ["agpl3_free"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("LGPL-2.1-or-later", ["lgpl21_free"]),
    ("Zlib", ["zlib_as_is", "zlib_grant"]),
    ("BSL-1.0", ["bsl_grant"]),
    ("ISC", ["isc_grant"]),
    ("Unlicense", ["unlicense"]),
    ("EPL-2.0", ["epl2_name"]),
    ("Apache-2.0", ["apache2_name"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("GPL-3.0-only", ["gpl3_name"]),
    ("GPL-2.0-only", ["gpl2_name"]),
    ("BSD-3-Clause", ["bsd3_name"]),
    ("BSD-2-Clause", ["bsd2_name"]),
    ("MPL-2.0", ["mpl2_name"]),
    ("Apache-2.0", ["apache2_text"]),
    ("MPL-2.0", ["mpl2_text"]),
    ("EPL-2.0", ["epl2_text"]),
    ("BSL-1.0", ["bsl_text"]),
    ("LicenseRef-BSD", ["bsd_style"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_name"]),
    ("CC-BY-NC-4.0", ["cc_by_nc4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa4"]),
    ("CC-BY-4.0", ["cc_by4"]),
    ("CC0-1.0", ["cc0"]),
    ("CC0-1.0", ["cc0_text"]),
]
# `All rights reserved` counts by itself only: beside no other known notice, and where the text says nothing of a licence or a permission.
RESERVED, SIGN = ("proprietary", "reserved"), r"licen[cs]|redistribut|permission|permitted"
# Sentences as the SQL sees them.
END = r"[.!?:;]+[ \t\r\n]+|\n+|[.!?:;]+\z"
OTHER = r"[^a-z0-9\n]+"
# The tag's colon ends no sentence for either.
TAG_END = ("license-identifier:", "license-identifier ")
# `2.0+` is a later version too.
LATER = (r"([0-9])\+", " or later")
TAG_WORDS = "spdx license identifier "
# Sentences as scan() sees them: marks that begin a line (comments, bullets) go, `v. 2` is no end, and so is a single line break.
STEPS = [
    TAG_END,
    (LATER[0], "$1" + LATER[1]),
    (r"(\A|\n)[^a-z0-9\n]+", "$1"),
    (r"\bv\.[ \t\r\n]+(?=[0-9])", "v "),
    (r"(?<![.!?:;])[.!?:;]++(?:[ \t\r\n]+|\z)|\n[^a-z0-9]*\n", "\u0001"),
    (r"[^a-z0-9\n\u0001]+", " "),
    (r" ?\n ?", " | "),
    (r" ?\u0001 ?", " . "),
]


def marked(text: Column) -> Column:
    """The text's words: lower case, letters and digits of ASCII, one space between them; ` . ` ends a sentence, ` | ` is a line break inside one."""
    out = F.lower(text)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(by))
    return F.concat(F.lit(" . "), out, F.lit(" . "))


def notices() -> dict[str, str]:
    """The words of a notice, ` . ` between its sentences -> identifier."""
    ends = lambda s: re.split(r"[.!?:;]+(?:\s+|\Z)", re.sub(r"\bv\.\s+(?=\d)", "v ", s.lower().replace(*TAG_END)))
    return {" . ".join(" ".join(re.findall("[a-z0-9]+", x)) for x in ends(s) if x): name for name, said in SENTENCES.items() for s in said}


def varied(words: str, space: str = " ") -> str:
    """A notice of VARIED as a pattern, with what may stand between two of its words."""
    slot = lambda m: f"[a-z0-9]+(?: [a-z0-9]+){{0,{int(m[1]) - 1}}}"
    return re.sub(r"<(\d+)>", slot, words).replace(" ", space)


def tags() -> str:
    """Several names in one tag: MIT or Apache-2.0."""
    one = "(?:" + "|".join(sorted((k.removeprefix(TAG_WORDS) for k in notices() if k.startswith(TAG_WORDS)), key=len, reverse=True)) + ")"
    return f"{TAG_WORDS}{one}(?: (?:or|and) {one})+"


def pattern() -> str:
    """Any notice, the longest first, then those with parts that vary; it begins and ends with a sentence or a line. Lines may break between its words."""
    gap = r"(?: \|)? "
    one = lambda n: r" \. ".join(x.replace(" ", gap) for x in n.split(" . "))
    said = [*map(one, sorted(notices(), key=len, reverse=True)), tags().replace(" ", gap), *(varied(v, gap) for _, v in VARIED)]
    return r"(?<= [.|] )(?:" + "|".join(said) + r")(?= [.|] )"


def normal(sentence: str) -> list[str]:
    text = re.sub(OTHER, " ", re.sub(END.replace(r"\z", r"\Z"), "\n", re.sub(LATER[0], r"\1" + LATER[1], sentence.lower().replace(*TAG_END))))
    return [s.strip() for s in text.split("\n") if s.strip()]


def known() -> dict[str, str]:
    """Normal sentence -> identifier, for the SQL, which knows a notice of several sentences by its last one."""
    return {normal(s)[-1]: name for name, said in SENTENCES.items() for s in said}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, licence (of the first rule that fits; null if none does), licences (of
    all that fit, in rule order, joined by commas), sentence_ids (of the known notices, in text order) and n_known.

    A notice is met where all its sentences follow each other, wrapped over lines (commented ones too) or not, from the begin of a sentence or
    line to the end of one; parts of it may vary (VARIED: a holder's name, what the name stands for, where to look). A tag may have several
    names with OR and AND between them, each its own identifier; one with an exception (WITH) is not known. A whole licence text is known by its
    title. `proprietary` stands alone: where rights are reserved and nothing else speaks of a licence. The SQL meets unwrapped notices only,
    and those of several sentences by their last one.

    Rows are independent: no shuffle, no Python. A null or empty text knows no sentence (licence null, the strings
    empty, n_known 0). Repeated rows and null ids pass through, an empty table gives an empty result, long texts are
    read whole, other columns are ignored.
    """
    table = F.create_map(*(F.lit(x) for kv in notices().items() for x in kv))
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.regexp_extract_all(marked(text), F.lit(pattern()), F.lit(0))
    # ` or later` is part of a name.
    each = lambda s: F.transform(F.split(F.replace(F.substring(s, len(TAG_WORDS) + 1, 1 << 30), F.lit(" or later"), F.lit("+")), " (?:or|and) "), lambda x: F.element_at(table, F.concat(F.lit(TAG_WORDS), F.replace(x, F.lit("+"), F.lit(" or later")))))
    other = lambda s: F.coalesce(*(F.when(s.rlike(f"^(?:{varied(v)})$"), F.lit(name)) for name, v in VARIED))
    names = lambda s: F.when(F.startswith(s, F.lit(TAG_WORDS)), each(s)).otherwise(F.array(F.coalesce(F.element_at(table, s), other(s))))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.flatten(F.transform(found, lambda s: names(F.replace(s, F.lit(" |"), F.lit(""))))).alias("ids"), F.lower(text).rlike(SIGN).alias("sign"))
    line = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    alone = F.when((F.size("ids") > 0) & F.forall("ids", lambda x: x == RESERVED[1]) & ~F.col("sign"), F.lit(RESERVED[0]))
    fits = F.array_compact(F.array(*(F.when(line.contains(" " + " ".join(seq) + " "), F.lit(name)) for name, seq in RULES), alone))
    out = ids.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_known"), F.array_distinct(fits).alias("fits"))
    return out.select(F.col("doc_id").alias(id_col), F.try_element_at("fits", F.lit(1)).alias("licence"), F.array_join("fits", ",").alias("licences"), "sentence_ids", "n_known")


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    names = known()
    keys, values = ", ".join(map(q, names)), ", ".join(map(q, names.values()))
    fits = ", ".join(f"CASE WHEN contains(line, {q(' ' + ' '.join(seq) + ' ')}) THEN {q(name)} END" for name, seq in RULES)
    other = " ".join(f"WHEN regexp_full_match(x, {q(varied(v))}) THEN [{q(name)}]" for name, v in VARIED)
    each = f"list_transform(string_split_regex(replace(substr(x, {len(TAG_WORDS) + 1}), ' or later', '+'), ' (?:or|and) '), lambda y: list_extract([{values}], list_position([{keys}], {q(TAG_WORDS)} || replace(y, '+', ' or later'))))"
    return f"""
    WITH s AS (
      SELECT doc_id, regexp_matches(lower(coalesce(text, '')), {q(SIGN)}) AS sign,
        list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), {q(TAG_END[0])}, {q(TAG_END[1])}), {q(LATER[0])}, {q(chr(92) + "1" + LATER[1])}, 'g'),
        {q(END)}, chr(10), 'g'), {q(OTHER)}, ' ', 'g'), chr(10)), lambda x: trim(x)) AS said
      FROM documents),
    i AS (SELECT doc_id, sign, flatten(list_transform(said, lambda x: CASE WHEN list_contains([{keys}], x) THEN [list_extract([{values}], list_position([{keys}], x))]
      WHEN regexp_full_match(x, {q(tags())}) THEN {each} {other} ELSE [] END)) AS ids FROM s),
    l AS (SELECT doc_id, ids, sign, ' ' || coalesce(array_to_string(ids, ' '), '') || ' ' AS line FROM i),
    f AS (SELECT doc_id, ids, list_filter([{fits}, CASE WHEN len(ids) > 0 AND len(list_filter(ids, lambda x: x <> {q(RESERVED[1])})) = 0 AND NOT sign THEN {q(RESERVED[0])} END], lambda x: x IS NOT NULL) AS fits FROM l)
    SELECT doc_id, fits[1] AS licence,
      coalesce(array_to_string(list_filter(fits, lambda x, k: list_position(fits, x) = k), ','), '') AS licences,
      coalesce(array_to_string(ids, ','), '') AS sentence_ids, len(ids)::BIGINT AS n_known
    FROM f"""
