"""Licence scans by sentence rules, in DataFrame operations only.

Sentences are normalised and looked up in a table of known licence sentences; the identifiers found, in order, are
matched with ordered rules that allow a few other identifiers between theirs, and what a rule has matched is taken out
before the next one is tried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_text

#: fixed values: sentences of public licence texts and headers, as they are written -> identifier. A text is cut at colons
#: and semicolons too, so these are the parts between.
WRITTEN = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "MitGrant"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "MitNotice"),
    ("The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software", "MitNotice"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", "MitAsIs"),
    ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE", "MitLiable"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\")", "ApacheNote2"),
    ("Licensed under the Apache License, Version 2.0", "ApacheNote2"),
    ("you may not use this file except in compliance with the License", "ApacheComply"),
    ("You may obtain a copy of the License at", "ApacheObtain"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "ApacheAsIs"),
    ("See the License for the specific language governing permissions and limitations under the License", "ApacheSee"),
    ("Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form", "ApacheGrant"),
    ("This program is free software", "GplFree"),
    ("This file is free software", "GplFree"),
    ("This library is free software", "LgplFree"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "Gpl3May"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version", "Gpl2May"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "GplMay"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "Gpl2Only"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation", "Gpl2Only"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation", "Gpl3Only"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "Lgpl3May"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version", "Lgpl21May"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "LgplMay"),
    ("you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation", "LgplMay"),
    ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "Agpl3May"),
    ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "AgplMay"),
    ("either version 3 of the License, or (at your option) any later version", "Later3"),
    ("either version 2.1 of the License, or (at your option) any later version", "Later21"),
    ("either version 2 of the License, or (at your option) any later version", "Later2"),
    ("version 2 of the License", "Only2"),
    ("version 2.1 of the License", "Only21"),
    ("version 3 of the License", "Only3"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "GplUseful"),
    ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "LgplUseful"),
    ("without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE", "GplImplied"),
    ("See the GNU General Public License for more details", "GplSee"),
    ("See the GNU Lesser General Public License for more details", "LgplSee"),
    ("See the GNU Affero General Public License for more details", "AgplSee"),
    ("The GNU General Public License is a free, copyleft license for software and other kinds of works", "Gpl3Preamble"),
    ("By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users", "Gpl2Preamble"),
    ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software", "Agpl3Preamble"),
    ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below", "Lgpl3Preamble"),
    ("This work is licensed under the GNU General Public License version 3", "GplNote3"),
    ("This work is licensed under the GNU General Public License version 2", "GplNote2"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v", "MplNote2"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "MplObtain"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "MplObtain"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EplNote2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "BsdGrant"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "BsdSource"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "BsdBinary"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BsdEndorse"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement", "BsdAdvert"),
    ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED", "BsdAsIs"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "IscGrant"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "IscGrant"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ZeroBsdGrant"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS", "IscAsIs"),
    ("This software is provided 'as-is', without any express or implied warranty", "ZlibAsIs"),
    ("In no event will the authors be held liable for any damages arising from the use of this software", "ZlibLiable"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "ZlibGrant"),
    ("The origin of this software must not be misrepresented", "ZlibOrigin"),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", "ZlibAltered"),
    ("This is free and unencumbered software released into the public domain", "UnlicenseNote"),
    ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "UnlicenseGrant"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following", "BoostGrant"),
    ("Distributed under the Boost Software License, Version 1.0", "BoostNote"),
    ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law", "Cc0Deed"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Cc0Waiver"),
    ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "Cc0Waiver"),
    ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", "WtfplGrant"),
    ("All rights reserved", "AllRights"),
)
#: fixed values: names that short notes use -> licence
NAMES = (
    ("MIT License", "MIT"),
    ("Apache License 2.0", "Apache-2.0"),
    ("BSD 3-Clause License", "BSD-3-Clause"),
    ("BSD 2-Clause License", "BSD-2-Clause"),
    ("ISC License", "ISC"),
    ("zlib License", "Zlib"),
    ("Boost Software License 1.0", "BSL-1.0"),
    ("Mozilla Public License 2.0", "MPL-2.0"),
    ("GNU General Public License v3.0", "GPL-3.0-only"),
    ("GNU General Public License v2.0", "GPL-2.0-only"),
    ("GNU Lesser General Public License v3.0", "LGPL-3.0-only"),
    ("GNU Lesser General Public License v2.1", "LGPL-2.1-only"),
    ("GNU Affero General Public License v3.0", "AGPL-3.0-only"),
    ("Eclipse Public License 2.0", "EPL-2.0"),
)
NOTES = ("Released under the {}", "Licensed under the {}", "Distributed under the {}", "This project is licensed under the {}", "This software is licensed under the {}", "This work is licensed under the {}")
#: fixed values: elements of Creative Commons licences, as long and as short names
COMMONS = (("Attribution", "BY"), ("Attribution-ShareAlike", "BY-SA"), ("Attribution-NoDerivatives", "BY-ND"), ("Attribution-NonCommercial", "BY-NC"), ("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"), ("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"))
#: fixed values: rules in order, the longer ones first; identifiers in sequence -> licence
WRITTEN_RULES = (
    (("MitGrant", "MitNotice", "MitAsIs"), "MIT"),
    (("MitGrant", "MitNotice"), "MIT"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse"), "BSD-4-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"), "BSD-3-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary"), "BSD-2-Clause"),
    (("BsdGrant", "BsdSource"), "BSD-1-Clause"),
    (("GplFree", "Gpl3May"), "GPL-3.0-or-later"),
    (("GplFree", "Gpl2May"), "GPL-2.0-or-later"),
    (("GplFree", "GplMay", "Later3"), "GPL-3.0-or-later"),
    (("GplFree", "GplMay", "Later2"), "GPL-2.0-or-later"),
    (("GplFree", "GplMay", "Only3"), "GPL-3.0-only"),
    (("GplFree", "GplMay", "Only2"), "GPL-2.0-only"),
    (("GplFree", "Agpl3May"), "AGPL-3.0-or-later"),
    (("GplFree", "AgplMay", "Later3"), "AGPL-3.0-or-later"),
    (("GplFree", "AgplMay", "Only3"), "AGPL-3.0-only"),
    (("LgplFree", "Lgpl3May"), "LGPL-3.0-or-later"),
    (("LgplFree", "Lgpl21May"), "LGPL-2.1-or-later"),
    (("LgplFree", "LgplMay", "Later3"), "LGPL-3.0-or-later"),
    (("LgplFree", "LgplMay", "Later21"), "LGPL-2.1-or-later"),
    (("LgplFree", "LgplMay", "Later2"), "LGPL-2.0-or-later"),
    (("LgplFree", "LgplMay", "Only21"), "LGPL-2.1-only"),
    (("GplFree", "Lgpl3May"), "LGPL-3.0-or-later"),
    (("GplFree", "LgplMay", "Later3"), "LGPL-3.0-or-later"),
    (("GplFree", "LgplMay", "Later21"), "LGPL-2.1-or-later"),
    (("ApacheNote2", "ApacheComply", "ApacheAsIs", "ApacheSee"), "Apache-2.0"),
    (("ApacheNote2", "ApacheComply"), "Apache-2.0"),
    (("ZlibAsIs", "ZlibGrant", "ZlibOrigin"), "Zlib"),
    (("UnlicenseNote", "UnlicenseGrant"), "Unlicense"),
    (("MplNote2", "MplObtain"), "MPL-2.0"),
    (("Gpl2Only",), "GPL-2.0-only"),
    (("Gpl3Only",), "GPL-3.0-only"),
    (("Gpl3May",), "GPL-3.0-or-later"),
    (("Gpl2May",), "GPL-2.0-or-later"),
    (("Gpl3Preamble",), "GPL-3.0-only"),
    (("Gpl2Preamble",), "GPL-2.0-only"),
    (("Agpl3Preamble",), "AGPL-3.0-only"),
    (("Lgpl3Preamble",), "LGPL-3.0-only"),
    (("GplNote3",), "GPL-3.0-only"),
    (("GplNote2",), "GPL-2.0-only"),
    (("IscGrant",), "ISC"),
    (("ZeroBsdGrant",), "0BSD"),
    (("ZlibGrant",), "Zlib"),
    (("UnlicenseNote",), "Unlicense"),
    (("BoostGrant",), "BSL-1.0"),
    (("BoostNote",), "BSL-1.0"),
    (("ApacheGrant",), "Apache-2.0"),
    (("ApacheNote2",), "Apache-2.0"),
    (("MplNote2",), "MPL-2.0"),
    (("EplNote2",), "EPL-2.0"),
    (("Cc0Deed",), "CC0-1.0"),
    (("Cc0Waiver",), "CC0-1.0"),
    (("WtfplGrant",), "WTFPL"),
)
#: one of these is in every known sentence; texts without them hold none
HINTS = ("licen", "permi", "copyright", "warrant", "redistribut", "software", "rights reserved", "public domain", "mpl")
#: other identifiers that may stand between two of a rule
GAP = 3
#: names in two well-known sentences, whatever they are, become 'the copyright holder' and so on
HOLDERS = (
    ("^neither the name of .* nor the names of .* may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("^this software is provided by .* as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
)


def plain(sentence: str) -> str:
    """What normalised() makes of a sentence, for the table of known ones."""
    return re.sub(r"(^| )\.+|\.+( |$)", " ", re.sub("[^a-z0-9.]+", " ", sentence.lower())).strip()


def _known() -> tuple[dict[str, str], tuple[tuple[tuple[str, ...], str], ...]]:
    """(normalised sentence -> identifier, rules): the fixed ones and those that names give by rule."""
    found = {plain(s): i for s, i in WRITTEN}
    named = dict.fromkeys(licence for _, licence in (*WRITTEN_RULES, *NAMES))
    rules = [(("Tag-" + x,), x) for x in named]
    for licence in named:
        found[plain(f"SPDX-License-Identifier {licence}")] = "Tag-" + licence
    for name, licence in NAMES:
        for note in NOTES:
            found.setdefault(plain(note.format(name)), "Note-" + licence)
        rules.append((("Note-" + licence,), licence))
    for long, short in COMMONS:
        for version, place in (("4.0", "International"), ("3.0", "Unported")):
            licence = f"CC-{short}-{version}"
            for s in (f"This work is licensed under a Creative Commons {long} {version} {place} License", f"Licensed under CC {short} {version}", f"SPDX-License-Identifier {licence}"):
                found[plain(s)] = licence
            rules.append(((licence,), licence))
    return found, (*WRITTEN_RULES, *rules, (("AllRights",), "Proprietary"))


SENTENCES, RULES = _known()


def normalised(sentence: Column) -> Column:
    """Lower case; only letters, digits, and dots or single blanks between them stay; holders' names are made alike."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " "), "(^| )\\.+|\\.+( |$)", " "))
    for pattern, alike in HOLDERS:
        out = F.when(out.rlike(pattern), F.regexp_replace(out, pattern, alike)).otherwise(out)
    return out


#: a sentence ends at a mark before white space; an empty line, be it in a comment, ends it too; so does a line's end, by line
ENDS = "[.;:!?]+\\s+|\n[ \t\r#*/%;>-]*\n"
LINE_ENDS = "[.;:!?]+\\s+|\n+"
TAG = "(?i)SPDX-License-Identifier:"


def _found(text: Column, ends: str) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    table = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    hint = "|".join(HINTS)
    likely = F.filter(F.split(F.regexp_replace(text, TAG, "SPDX-License-Identifier "), ends), lambda s: F.lower(s).rlike(hint))
    ids = F.transform(F.transform(likely, normalised), lambda s: F.try_element_at(table, s))
    return F.filter(ids, lambda x: x.isNotNull())


def pattern(sequence: tuple[str, ...]) -> str:
    """Of ids that each stand between two blanks: these in sequence, with up to GAP others between two of them."""
    return f"((?: [^ ]+ ){{0,{GAP}}}?)".join(f" {re.escape(x)} " for x in sequence)


def _licences(ids: Column) -> Column:
    """Licences that the rules find in the identifiers, as often as they match and in the rules' order."""
    rules = F.array(*(F.struct(F.lit(pattern(q)).alias("p"), F.lit("".join(f"${i}" for i in range(1, len(q)))).alias("rest"), F.lit(x).alias("licence")) for q, x in RULES))
    start = F.struct(F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc, rule):
        hit = F.rlike(acc["left"], rule["p"])
        return F.struct(F.when(hit, F.regexp_replace(acc["left"], rule["p"], rule["rest"])).otherwise(acc["left"]).alias("left"), F.when(hit, F.array_append(acc["found"], rule["licence"])).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rules, start, step, lambda acc: acc["found"])


def scan_licences(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, sentences (identifiers in order), licences (distinct, in the rules' order).

    Texts are read in two ways, with line ends as sentence ends and as blanks, so that wrapped sentences and one-line
    notes are both found; the longer list of identifiers is reported, and the licences of both. Null or empty text:
    empty lists. Rows that repeat are scanned each; a null doc_id stays null; an empty table gives an empty result;
    other columns are ignored, whatever their names."""
    none = F.array().cast("array<string>")
    seen = F.lower("text").rlike("|".join(HINTS))
    rows = ids_text(docs).withColumn("seen", seen)
    rows = rows.select("doc_id", *(F.when(F.col("seen"), _found(F.col("text"), e)).otherwise(none).alias(c) for c, e in (("a", LINE_ENDS), ("b", ENDS))))
    rows = rows.select("doc_id", "a", "b", *(F.when(F.size(c) > 0, _licences(F.col(c))).otherwise(none).alias("l" + c) for c in ("a", "b")))
    order = F.array(*(F.lit(x) for x in dict.fromkeys(licence for _, licence in RULES)))
    both = F.when(F.size("la") + F.size("lb") > 0, F.filter(order, lambda x: F.array_contains("la", x) | F.array_contains("lb", x))).otherwise(none)
    return rows.select("doc_id", F.when(F.size("a") >= F.size("b"), F.col("a")).otherwise(F.col("b")).alias("sentences"), both.alias("licences"))
