"""Wordings of public licences: short notices and, where they are short enough to be quoted whole, the grants themselves.
Each is a list of phrases that are joined by blanks; a licence may have several wordings."""

from __future__ import annotations

_AS_IS = [
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY',
    "OF ANY KIND, EXPRESS OR IMPLIED,",
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,",
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE",
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,",
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,",
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
_BSD_HEAD = [
    "Redistribution and use in source and binary forms, with or without modification,",
    "are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice,",
    "this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice,",
    "this list of conditions and the following disclaimer",
    "in the documentation and/or other materials provided with the distribution.",
]
_BSD_THIRD = [
    "3. Neither the name of the copyright holder nor the names of its contributors",
    "may be used to endorse or promote products derived from this software",
    "without specific prior written permission.",
]


def _gnu(name: str, version: str) -> list[str]:
    return [
        "This program is free software: you can redistribute it and/or modify",
        f"it under the terms of the {name} as published by",
        f"the Free Software Foundation, either version {version} of the License,",
        "or (at your option) any later version.",
    ]


def _forms(name: str) -> list[list[str]]:
    return [[f"Licensed under {name}."], [f"This work is licensed under {name}."], [f"Released under {name}."], [f"This project is distributed under {name}."]]


WORDINGS: dict[str, list[list[str]]] = {
    "MIT": [
        *_forms("the MIT License"),
        ["SPDX-License-Identifier: MIT"],
        [
            "Permission is hereby granted, free of charge, to any person",
            'obtaining a copy of this software and associated documentation files (the "Software"),',
            "to deal in the Software without restriction, including without limitation the rights",
            "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,",
            "and to permit persons to whom the Software is furnished to do so,",
            "subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included",
            "in all copies or substantial portions of the Software.",
            *_AS_IS,
        ],
    ],
    "Apache-2.0": [
        *_forms("the Apache License, Version 2.0"),
        ["SPDX-License-Identifier: Apache-2.0"],
        [
            'Licensed under the Apache License, Version 2.0 (the "License");',
            "you may not use this file except in compliance with the License.",
            "You may obtain a copy of the License at",
            "http://www.apache.org/licenses/LICENSE-2.0",
        ],
    ],
    "BSD-2-Clause": [*_forms("the BSD 2-Clause License"), ["SPDX-License-Identifier: BSD-2-Clause"], _BSD_HEAD],
    "BSD-3-Clause": [*_forms("the BSD 3-Clause License"), ["SPDX-License-Identifier: BSD-3-Clause"], [*_BSD_HEAD, *_BSD_THIRD]],
    "ISC": [
        *_forms("the ISC License"),
        ["SPDX-License-Identifier: ISC"],
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose",
            "with or without fee is hereby granted, provided that the above copyright notice",
            "and this permission notice appear in all copies.",
        ],
    ],
    "GPL-2.0": [*_forms("the GNU General Public License, version 2"), ["SPDX-License-Identifier: GPL-2.0-only"], _gnu("GNU General Public License", "2")],
    "GPL-3.0": [*_forms("the GNU General Public License, version 3"), ["SPDX-License-Identifier: GPL-3.0-only"], _gnu("GNU General Public License", "3")],
    "LGPL-2.1": [*_forms("the GNU Lesser General Public License, version 2.1"), ["SPDX-License-Identifier: LGPL-2.1-only"], _gnu("GNU Lesser General Public License", "2.1")],
    "LGPL-3.0": [*_forms("the GNU Lesser General Public License, version 3"), ["SPDX-License-Identifier: LGPL-3.0-only"], _gnu("GNU Lesser General Public License", "3")],
    "AGPL-3.0": [*_forms("the GNU Affero General Public License, version 3"), ["SPDX-License-Identifier: AGPL-3.0-only"], _gnu("GNU Affero General Public License", "3")],
    "MPL-2.0": [
        *_forms("the Mozilla Public License, version 2.0"),
        ["SPDX-License-Identifier: MPL-2.0"],
        ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file,", "You can obtain one at http://mozilla.org/MPL/2.0/."],
    ],
    "EPL-2.0": [*_forms("the Eclipse Public License, version 2.0"), ["SPDX-License-Identifier: EPL-2.0"]],
    "BSL-1.0": [*_forms("the Boost Software License, Version 1.0"), ["SPDX-License-Identifier: BSL-1.0"], ["Distributed under the Boost Software License, Version 1.0."]],
    "Zlib": [*_forms("the zlib License"), ["SPDX-License-Identifier: Zlib"]],
    "Unlicense": [*_forms("the Unlicense"), ["SPDX-License-Identifier: Unlicense"], ["This is free and unencumbered software released into the public domain."]],
    "CC0-1.0": [*_forms("CC0 1.0"), ["SPDX-License-Identifier: CC0-1.0"], ["To the extent possible under law, the author has waived all copyright", "and related or neighboring rights to this work."]],
}
for _code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _version in ("3.0", "4.0"):
        WORDINGS[f"CC-{_code}-{_version}"] = [*_forms(f"CC {_code} {_version}"), [f"SPDX-License-Identifier: CC-{_code}-{_version}"]]
for _code, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial")):
    WORDINGS[f"CC-{_code}-4.0"].append([f"This work is licensed under a Creative Commons {_long} 4.0 International License."])

TEMPLATES: list[tuple[str, str]] = [(name, " ".join(phrases)) for name, wordings in WORDINGS.items() for phrases in wordings]

#: No licence, but the statement that there is none.
RESERVED = ("All-Rights-Reserved", "All rights reserved.")
