"""Licenses as templates of words, and the words that decide between them."""

from __future__ import annotations

# Notices by which works state their license, file headers, and short licenses.
PLAIN: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "Zlib-text": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS"
    ),
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at"
    ),
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
}

_GNU = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser", "2.1"), "LGPL-3.0": ("Lesser", "3"), "AGPL-3.0": ("Affero", "3")}
_GNU_NOTICE = "This work is licensed under the GNU {} General Public License, version {}."
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published "
    "by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_CC = {"BY": "", "BY-SA": "ShareAlike", "BY-NC": "NonCommercial", "BY-ND": "NoDerivatives", "BY-NC-SA": "NonCommercial ShareAlike", "BY-NC-ND": "NonCommercial NoDerivatives"}
_CC_LONG = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
_CC_SHORT = "Licensed under CC {} 4.0."
#: Elements of a license of that family, in the words by which notices name them.
_ELEMENTS = {"NC": "nc noncommercial non commercial", "SA": "sa sharealike share alike", "ND": "nd noderivatives noderivs derivatives no"}


#: Short identifiers, as SPDX lines have them, and the words that would make them another one.
_SPDX = {
    "MIT": "0", "Apache-2.0": "", "ISC": "", "BSD-2-Clause": "patent views", "BSD-3-Clause": "clear lbnl attribution", "Zlib": "", "Unlicense": "", "BSL-1.0": "", "MPL-2.0": "no",
    "GPL-2.0": "lgpl agpl", "GPL-3.0": "lgpl agpl", "LGPL-2.1": "", "LGPL-3.0": "", "AGPL-3.0": "", "CC0-1.0": "",
}

#: Bare names, all of whose words but "version" must stand there, and the words that would make them another one.
_TITLES = {
    "MIT": ("MIT License", "0 attribution"), "Apache-2.0": ("Apache License, Version 2.0", ""), "BSD-2-Clause": ("BSD 2-Clause License", ""), "BSD-3-Clause": ("BSD 3-Clause License", ""),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", ""), "BSL-1.0": ("Boost Software License, Version 1.0", ""), "GPL-2.0": ("GNU General Public License, Version 2", "lesser library affero"),
    "GPL-3.0": ("GNU General Public License, Version 3", "lesser library affero"), "LGPL-3.0": ("GNU Lesser General Public License, Version 3", ""), "AGPL-3.0": ("GNU Affero General Public License, Version 3", ""),
}


def _templates() -> tuple[dict[str, str], dict[str, tuple[str, str]]]:
    texts = dict(PLAIN)
    deciding = {
        "MIT": ("mit", ""), "Apache-2.0": ("apache 2 0", ""), "Apache-2.0-header": ("apache 2 0", ""), "MPL-2.0": ("mozilla 2 0", ""), "MPL-2.0-header": ("mozilla 2 0", ""),
        "BSD-2-Clause": ("bsd 2 clause", ""), "BSD-3-Clause": ("bsd 3 clause", ""),
    }
    for name, (kind, version) in _GNU.items():
        others = " ".join({"lesser", "library", "affero"} - {kind.lower()})
        for key, body in ((name, _GNU_NOTICE), (f"{name}-header", _GNU_HEADER)):
            texts[key] = body.format(kind, version)
            deciding[key] = (f"gnu {kind.lower()} general public {version.replace('.', ' ')}", others)
    for code, named in _CC.items():
        others = " ".join(words for element, words in _ELEMENTS.items() if element not in code.split("-"))
        texts[f"CC-{code}-4.0-name"] = _CC_LONG.format("".join(f"-{x}" for x in named.split()))
        deciding[f"CC-{code}-4.0-name"] = (f"creative commons attribution {named.lower()} 4 0", others)
        texts[f"CC-{code}-4.0"] = _CC_SHORT.format(code)
        deciding[f"CC-{code}-4.0"] = (f"cc {code.replace('-', ' ').lower()} 4 0", others)
    for name, others in _SPDX.items():
        texts[f"{name}-spdx"] = f"SPDX-License-Identifier: {name}"
        deciding[f"{name}-spdx"] = (f"spdx license identifier {name.replace('-', ' ').replace('.', ' ').lower()}", others)
    for name, (title, others) in _TITLES.items():
        texts[f"{name}-title"] = title
        deciding[f"{name}-title"] = (title.lower().replace(",", "").replace("-", " ").replace(".", " ").replace("version ", ""), others)
    for code in _CC:
        texts[f"CC-{code}-4.0-title"] = f"CC {code} 4.0"
        deciding[f"CC-{code}-4.0-title"] = deciding[f"CC-{code}-4.0"]
    return texts, deciding


#: Texts by name.  A notice and a license's text are templates of their own.
#: Words without which a text names another license, all of which must be aligned, and words that make it another one, across
#: which none is aligned.
TEMPLATES, DECIDING = _templates()

# Words that say that a license does not hold, and common words that tell nothing of a license.
NEGATIONS = "not never isn aren no nor cannot longer"
COMMON = "a all an and any are as at be by can for from if in is it its no not of on one or our that the their this to under use used was we will with work you your"
