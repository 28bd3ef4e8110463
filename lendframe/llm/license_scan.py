"""License scans: Dice coefficient over word bigrams against licence templates.

A text is normalised to lower-case words, and windows of a template's own number of words slide over the whole text,
beginning wherever one of the template's bigrams does. Size bounds prune the templates of a text first: a Dice
coefficient of d needs sizes whose ratio is within d / (2 - d) and its inverse, so a text that shares fewer bigrams
with a template than the least admitted number has no window to compare. Texts without any of the words that every
match must hold (``anchors``) are not split at all. Of overlapping matches the best stays, and a licence is named only
if the words of its variant and version stand in the window too.

The templates are a list of bounded size, a literal in the plan; no document is compared with another.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.llm.common import let, merged, unused

# Licences by identifier, and the names that texts give them.
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_GNU = (
    ("GPL-2.0", "General", "GPL", "2"), ("GPL-3.0", "General", "GPL", "3"), ("LGPL-2.1", "Lesser General", "LGPL", "2.1"),
    ("LGPL-3.0", "Lesser General", "LGPL", "3"), ("AGPL-3.0", "Affero General", "AGPL", "3"),
)
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0"),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    **{
        key: (
            f"GNU {kind} Public License, version {version}", f"GNU {kind} Public License v{version}", f"GNU {kind} Public License v{key.partition('-')[2]}",
            f"GNU {short} v{version}", f"{short} v{version}", f"{short}v{version}", f"{key} license",
        )
        for key, kind, short, version in _GNU
    },
    **{
        f"CC-{code}-{version}": (f"CC {code} {version}", f"Creative Commons {name} {version}", f"Creative Commons {name} {version} {place} License")
        for code, name in _CC.items() for version, place in (("3.0", "Unported"), ("4.0", "International"))
    },
    "EUPL-1.2": ("European Union Public Licence v. 1.2", "European Union Public Licence version 1.2", "EUPL 1.2", "EUPL v1.2"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, version 2.0"),
    "WTFPL": ("Do What The Fuck You Want To Public License", "WTFPL"),
}
for _code, _name in _CC.items():  # the version may come last, and without a place
    for _version in ("3.0", "4.0"):
        NAMES[f"CC-{_code}-{_version}"] += (f"Creative Commons {_name} License {_version}",)
#: Names in passing, for statements too short for a whole name (fixed values).
SHORT = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache 2.0", "Apache-2.0"), "BSD-2-Clause": ("BSD-2-Clause",), "BSD-3-Clause": ("BSD-3-Clause",), "MPL-2.0": ("MPL 2.0",),
    "EPL-2.0": ("EPL 2.0",), "ISC": ("ISC",), "GPL-2.0": ("GPLv2", "GPL-2.0"), "GPL-3.0": ("GPLv3", "GPL-3.0"), "LGPL-2.1": ("LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("LGPLv3", "LGPL-3.0"), "AGPL-3.0": ("AGPLv3", "AGPL-3.0"), "CC0-1.0": ("CC0-1.0",), "EUPL-1.2": ("EUPL-1.2",), "WTFPL": ("WTFPL",), "Unlicense": ("Unlicense",),
}
SHORT_FORMS = ("License: {}", "{} licensed", "is {} licensed", "{} license, see LICENSE file", "{} license, see the LICENSE file")
#: Licences that are offered together, "A OR B" in either order (fixed values).
EITHER = (("MIT", "Apache-2.0"), ("Apache-2.0", "GPL-2.0"), ("MIT", "GPL-2.0"), ("MIT", "GPL-3.0"), ("MPL-2.0", "GPL-2.0"), ("BSD-3-Clause", "GPL-2.0"), ("MIT", "BSD-3-Clause"), ("MIT", "Unlicense"))
#: How texts declare a licence of a name (fixed values).
FORMS = (
    "Licensed under {}", "Licensed under the {}", "Licensed under a {}", "Released under the {}", "Distributed under the {}", "Under the terms of the {}",
    "Available under the {}",
)
# The wording of licences and their notices.
_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published "
    "by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
#: How the GNU licences begin, and their dates in the order of ``_GNU``.
_DATES = ("June 1991 Copyright (C) 1989, 1991", "29 June 2007 Copyright (C) 2007", "February 1999 Copyright (C) 1991, 1999", "29 June 2007 Copyright (C) 2007", "19 November 2007 Copyright (C) 2007")
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies."
)
_UNENCUMBERED = "This is free and unencumbered software released into the public domain."
TEXTS = (
    ("BSD-3-Clause", f"{_BSD}{_THIRD} {_DISCLAIMER}"),
    ("BSD-2-Clause", f"{_BSD} {_DISCLAIMER}"),
    (
        "MIT",
        f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        f"{_ISC} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must "
        "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked "
        "as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and "
        "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following:",
    ),
    (
        "Unlicense",
        f"{_UNENCUMBERED} Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    ),
    *((key, _NOTICE.format(kind, version)) for key, kind, _, version in _GNU),
    *(
        (key, f"GNU {kind} Public License Version {key.partition('-')[2].removesuffix('.0')}, {date} Free Software Foundation, Inc. {place}{_VERBATIM}")
        for (key, kind, _, _), date in zip(_GNU, _DATES)
        for place in ("", "<https://fsf.org/> ", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA ")
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    ),
    ("Artistic-2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("MIT", _GRANT), ("ISC", _ISC), ("Unlicense", _UNENCUMBERED), ("BSD-3-Clause", _BSD.partition(":")[0]),
)
#: Words that tell licences of one family apart: a window has those of the template and no others (fixed values).
VARIANTS = ("affero", "lesser", "library", "nc", "nd", "noncommercial", "noderivatives", "noderivs", "sa", "sharealike")
#: Words too common to tell a text that may hold a licence (fixed values).
COMMON = frozenset(
    "a all an and any are as at be but by can do for from have if in including is it no not of on one or other out shall so such that the this to "
    "under use used was which will with without you".split()
)
THRESHOLD = 0.8


def normal_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower().replace("licence", "license"))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most distinct bigrams of a window that can reach the threshold with a template of ``size``."""
    low = next(n for n in range(1, size + 1) if 2 * n >= threshold * (n + size))
    high = size
    while 2 * size >= threshold * (size + high + 1):
        high += 1
    return low, high


@dataclass(frozen=True)
class Template:
    license: str
    words: int
    grams: tuple[str, ...]
    required: tuple[str, ...]
    variants: tuple[str, ...]
    low: int
    high: int
    need: int

    @staticmethod
    def of(license: str, text: str, threshold: float, name: str = "") -> Template:
        """name: what a window must hold word for word."""
        words = normal_words(text)
        grams = tuple(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
        low, high = bounds(len(grams), threshold)
        variants = tuple(w for w in VARIANTS if w in words)
        # numbers of short statements are versions
        numbers = tuple(w for w in dict.fromkeys(words) if any(c.isdigit() for c in w)) if len(words) < 40 else ()
        required = tuple(dict.fromkeys((*normal_words(name), *numbers, *variants)))
        return Template(license, len(words), grams, required, variants, low, high, math.ceil(threshold * (low + len(grams)) / 2 - 1e-9))


def wordings() -> list[tuple[str, str, str]]:
    """(licence, wording, name) of all templates: whole texts, identifier lines, statements in passing, then every form with every name."""
    texts = [(key, text, "") for key, text in TEXTS]
    # of equal matches the one that says more comes first
    lines = [(f"{a} OR {b}", f"{start}{a} OR {b}", f"{a} or {b}") for one, two in EITHER for a, b in ((one, two), (two, one)) for start in ("SPDX-License-Identifier: ", "License: ", "Licensed under ", "")]
    lines += [(key, f"SPDX-License-Identifier: {key}", key) for key in NAMES]
    lines += [(key, form.format(name), name) for key, names in SHORT.items() for form in SHORT_FORMS for name in names]
    return [*texts, *lines, *((key, form.format(name), name) for key, names in NAMES.items() for form in FORMS for name in names)]


def read_wordings(folder: str) -> list[tuple[str, str]]:
    """(licence, wording) of the files of a folder, named by licence: whole texts beyond those here."""
    return [(name, open(os.path.join(folder, name), encoding="utf-8").read()) for name in sorted(os.listdir(folder)) if os.path.isfile(os.path.join(folder, name))]


def templates(threshold: float = THRESHOLD, more: list[tuple[str, str]] = ()) -> list[Template]:
    all_ = [*wordings(), *((key, text, "") for key, text in more)]
    made = [Template.of(key, text, threshold, name) for key, text, name in all_ if len(normal_words(text)) >= 2]
    return list({(t.license, t.grams): t for t in reversed(made)}.values())[::-1]


def anchors(made: list[Template]) -> list[str] | None:
    """Words of which every text that matches any template holds one; None if common words make up too much of a template.

    A match lacks at most size - need of a template's bigrams, so words that touch more of them can't all be absent.
    """
    open_, chosen = list(made), []
    free = {id(t): t.grams for t in made}
    while open_ := [t for t in open_ if len(free[id(t)]) >= t.need]:
        gain = Counter(w for t in open_ for g in free[id(t)] for w in set(g.split(" ")) if w not in COMMON and not w.isdigit())
        if not gain:
            return None
        best = min(gain, key=lambda w: (-gain[w], w))
        chosen.append(best)
        for t in open_:
            free[id(t)] = tuple(g for g in free[id(t)] if best not in g.split(" "))
    return chosen


_HIT = "struct<start:int,end:int,template:int,dice:double,license:string>"


def _matches(text: Column, threshold: float, made: list[Template]) -> Column:
    """array<struct<start,end,template,dice,license>> of the best matches, by place; in words, end exclusive."""
    none = F.array().cast(f"array<{_HIT}>")
    lowered = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("licence"), F.lit("license"))
    vocabulary = sorted({g for t in made for g in t.grams})
    fields = ("license", "words", "grams", "required", "variants", "low", "high", "need")
    rows = [{"number": n, **{f: getattr(t, f) for f in fields}} for n, t in enumerate(made)]
    table = F.from_json(
        F.lit(json.dumps(rows)),
        "array<struct<number:int,license:string,words:int,grams:array<string>,required:array<string>,variants:array<string>,low:int,high:int,need:int>>",
    )
    variants = F.array(*[F.lit(v) for v in VARIANTS])

    def window(t: Column, words: Column, grams: Column, mark: Column) -> Column:
        said = F.slice(words, mark["i"] + 1, t["words"])
        return let(
            F.struct(F.array_distinct(F.slice(grams, mark["i"] + 1, t["words"] - 1)).alias("g"), said.alias("w")),
            lambda x: F.when(
                (F.size(x["g"]) >= t["low"]) & (F.size(x["g"]) <= t["high"]) & (F.size(F.array_except(t["required"], x["w"])) == 0)
                & (F.size(F.array_except(F.array_intersect(x["w"], variants), t["variants"])) == 0),
                F.struct(
                    mark["i"].alias("start"), (mark["i"] + F.size(x["w"])).alias("end"), t["number"].alias("template"),
                    (2.0 * F.size(F.array_intersect(x["g"], t["grams"])) / (F.size(x["g"]) + F.size(t["grams"]))).alias("dice"), t["license"].alias("license"),
                ),
            ),
        )

    def of_template(t: Column, words: Column, grams: Column, marks: Column) -> Column:
        return let(
            F.filter(marks, lambda m: F.array_contains(t["grams"], m["g"])),
            lambda own: F.filter(
                F.transform(
                    own,
                    # a window of too few of the template's bigrams is not looked at
                    lambda m, k: F.when(F.get(own, k + t["need"] - 1)["i"] <= m["i"] + t["words"] - 2, window(t, words, grams, m)),
                ),
                lambda hit: F.coalesce(hit["dice"] >= threshold, F.lit(False)),
            ),
        )

    def best(kept: Column, hit: Column) -> Column:
        better = lambda last: (hit["dice"] > last["dice"]) | ((hit["dice"] == last["dice"]) & (hit["template"] < last["template"]))
        return F.when(F.size(kept) == 0, F.array(hit)).otherwise(
            let(
                F.get(kept, F.size(kept) - 1),
                lambda last: F.when(hit["start"] >= last["end"], F.concat(kept, F.array(hit)))
                .when(better(last), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(hit))).otherwise(kept),
            )
        )

    def of_words(words: Column) -> Column:
        grams = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
        return let(grams, lambda g: let(
            F.filter(F.transform(g, lambda x, i: F.struct(i.alias("i"), x.alias("g"))), lambda m: m["g"].isin(vocabulary)),
            lambda marks: let(
                F.array_distinct(F.transform(marks, lambda m: m["g"])),
                lambda seen: F.flatten(
                    F.transform(
                        F.filter(table, lambda t: F.size(F.array_intersect(t["grams"], seen)) >= t["need"]),
                        lambda t: of_template(t, words, g, marks),
                    )
                ),
            ),
        ))

    normal = F.split(F.btrim(F.regexp_replace(lowered, "[^\\p{L}\\p{N}]+", " ")), " ")
    hits = F.sort_array(let(normal, of_words).cast(f"array<{_HIT}>"))
    found = F.aggregate(hits, none, best)
    words = anchors(made)
    if words is None:
        return found
    return F.when(lowered.rlike("(?<![\\p{L}\\p{N}])(?:" + "|".join(words) + ")(?![\\p{L}\\p{N}])"), found).otherwise(none)


def scan(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, more: list[tuple[str, str]] = ()) -> DataFrame:
    """Every column of ``docs`` but the text, ``license``, ``dice``, ``licenses`` and ``n_found``.

    ``license``: that of the best match, NULL if none; ``dice``: its coefficient, 0 if none; ``licenses``: all licences
    found, sorted and joined by commas; ``n_found``: matches in the text. Of overlapping matches that of the higher
    coefficient stays, and ties go to the template that comes first: whole texts come before short statements.
    ``more``: (licence, wording) of further templates, such as ``read_wordings`` gives. Input columns of these names are
    replaced.

    Defined results: a NULL or empty text declares nothing. Texts of any length are read whole. Rows are scanned by
    themselves; repeated rows repeat their results. An empty table gives an empty result.
    """
    (hits,) = unused(docs, "found")
    made = templates(threshold, list(more))
    found = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], _matches(F.col(f"`{text_col}`"), threshold, made).alias(hits))
    # structs compare field by field
    best = F.array_min(F.transform(hits, lambda m: F.struct((-m["dice"]).alias("least"), m["template"].alias("template"), m["license"].alias("license"))))
    return merged(
        found,
        {
            "license": best["license"], "dice": F.coalesce(-best["least"], F.lit(0.0)),
            "licenses": F.array_join(F.sort_array(F.array_distinct(F.transform(hits, lambda m: m["license"]))), ","),
            "n_found": F.size(hits).cast("long"),
        },
    ).drop(hits)


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same result in SQL, by joins, without anchors and size bounds."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    list_ = lambda words: f"[{', '.join(map(text, words))}]::varchar[]"
    rows = ",\n    ".join(
        f"({n}, {text(t.license)}, {t.words}, {list_(t.grams)}, {list_(t.required)}, {list_(t.variants)})" for n, t in enumerate(templates(threshold))
    )
    return f"""
with template(template, license, words, grams, required, variants) as (values
    {rows}
), normal as (
  select doc_id, string_split(trim(regexp_replace(replace(lower(coalesce(text, '')), 'licence', 'license'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') as w from documents
), place as (
  select doc_id, w, unnest(range(len(w) - 1)) as i from normal
), gram as (
  select doc_id, i, w[i + 1] || ' ' || w[i + 2] as g from place
), piece as (
  select template, words, unnest(grams) as g from template
), mark as (
  select doc_id, template, words, i, g.g from gram g join piece using (g)
), likely as (
  select doc_id, template from mark join template using (template) group by doc_id, template, len(grams)
  having count(distinct g) >= {threshold} / (2 - {threshold}) * len(grams) - 1e-9
), begin as (
  select doc_id, template, words, i as start from mark join likely using (doc_id, template)
), window_ as (
  select b.doc_id, b.template, b.words, b.start, count(distinct g.g) as size, count(distinct p.g) as shared
  from begin b join gram g on g.doc_id = b.doc_id and g.i between b.start and b.start + b.words - 2
  left join piece p on p.template = b.template and p.g = g.g
  group by 1, 2, 3, 4
), hit as (
  select x.doc_id, x.start, least(x.start + x.words, len(n.w)) as stop, x.template, 2.0::double * shared / (size + len(t.grams)) as dice, t.license
  from window_ x join template t on x.template = t.template join normal n on n.doc_id = x.doc_id
  where 2.0::double * shared / (size + len(t.grams)) >= {threshold}
    and len(list_intersect(t.required, n.w[x.start + 1 : x.start + x.words])) = len(t.required)
    and len(list_filter(list_intersect(n.w[x.start + 1 : x.start + x.words], {list_(VARIANTS)}), lambda v: not list_contains(t.variants, v))) = 0
), swept as (
  select doc_id, list_reduce(
    list([{{'start': start, 'stop': stop, 'template': template, 'dice': dice, 'license': license}}] order by start, stop, template),
    lambda kept, h: case when h[1].start >= kept[len(kept)].stop then list_concat(kept, h)
      when h[1].dice > kept[len(kept)].dice or (h[1].dice = kept[len(kept)].dice and h[1].template < kept[len(kept)].template)
        then list_concat(kept[: len(kept) - 1], h)
      else kept end) as kept
  from hit group by doc_id
), kept as (
  select doc_id, unnest(kept, recursive := true) from (select doc_id, unnest(kept) as kept from swept)
), best as (
  select doc_id, arg_min(license, (-dice, template)) as license, max(dice) as dice, count(*) as n_found,
         string_agg(distinct license, ',' order by license) as licenses
  from kept group by doc_id
)
select d.doc_id, b.license, coalesce(b.dice, 0) as dice, coalesce(b.licenses, '') as licenses, coalesce(b.n_found, 0) as n_found
from documents d left join best b on d.doc_id = b.doc_id
"""
