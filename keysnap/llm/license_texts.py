"""Known licence texts and notices, as published, without copyright lines."""

from importlib import resources

# Short public licences and the notices that name longer ones.
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so"
)
_MIT = (
    _GRANT_MIT + ", subject to the following conditions:\n\nThe above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY_MIT
)
_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TERMS_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.\n\n"
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_GRANT_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

LICENCES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT-0", _GRANT_MIT + ".\n\n" + _WARRANTY_MIT),
    ("MIT-0", "MIT No Attribution\n\n" + _GRANT_MIT + ".\n\n" + _WARRANTY_MIT),
    ("BSD-2-Clause", _TERMS_BSD + _WARRANTY_BSD),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _TERMS_BSD + _WARRANTY_BSD),
    (
        "BSD-3-Clause",
        _TERMS_BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.\n\n" + _WARRANTY_BSD,
    ),
    (
        "BSD-3-Clause",
        "BSD 3-Clause License\n\n" + _TERMS_BSD + "3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission.\n\n" + _WARRANTY_BSD,
    ),
    (
        "ISC",
        _GRANT_ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        + _ISC_WARRANTY,
    ),
    (
        "ISC",
        "ISC License\n\n" + _GRANT_ISC + ", provided that the above copyright notice and this permission notice appear in "
        "all copies.\n\n" + _ISC_WARRANTY,
    ),
    ("0BSD", _GRANT_ISC + ".\n\n" + _ISC_WARRANTY),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, "
        "and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from "
        "any source distribution.",
    ),
)

NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License v3."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

# Long licences, as published.
_FILES = (
    ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"),
    ("MPL-2.0", "MPL-2.0"),
)
LICENCES += tuple(
    (name, resources.files(__package__).joinpath("licence_files", f"{file}.txt").read_text(encoding="utf-8"))
    for name, file in _FILES
)

# Notices are one sentence in many wordings: subject, verb, article, name and version.
_SUBJECTS = ("", "This work is ", "This software is ", "This program is ", "This project is ")
_VERBS = ("licensed under", "released under", "distributed under")
_NAMES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("MIT", ("MIT License", "MIT"), ()),
    ("ISC", ("ISC License",), ()),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License"), ()),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License"), ()),
    ("Apache-2.0", ("Apache License", "Apache"), ("2.0", "2")),
    ("GPL-2.0", ("GNU General Public License", "GNU GPL", "GPL"), ("2.0", "2")),
    ("GPL-3.0", ("GNU General Public License", "GNU GPL", "GPL"), ("3.0", "3")),
    ("LGPL-2.1", ("GNU Lesser General Public License", "GNU LGPL", "LGPL"), ("2.1",)),
    ("LGPL-3.0", ("GNU Lesser General Public License", "GNU LGPL", "LGPL"), ("3.0", "3")),
    ("AGPL-3.0", ("GNU Affero General Public License", "GNU AGPL", "AGPL"), ("3.0", "3")),
    ("MPL-2.0", ("Mozilla Public License", "MPL"), ("2.0", "2")),
    ("CC-BY-4.0", ("CC BY 4.0",), ()),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0",), ()),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0",), ()),
    ("CC0-1.0", ("CC0 1.0",), ()),
)
NOTICES += tuple(
    (licence, f"{subject}{verb} {article}{name}{version}")
    for licence, names, numbers in _NAMES
    for name in names
    for version in [f"{mark}{n}" for n in numbers for mark in (" v", " v. ", " version ", " ")] or [""]
    for article in ("the ", "")
    for verb in _VERBS
    for subject in _SUBJECTS
)
