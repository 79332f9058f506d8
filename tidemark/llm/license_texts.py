"""Known licence texts and one-line notices, by SPDX identifier."""

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""

_BSD_3 = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""


def _notices(*names: str) -> list[str]:
    """The usual one-line notices of a licence by its names."""
    frames = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the {}.", "Available under the {}.", "SPDX-License-Identifier: {}", "License: {}")
    return [frame.format(name) for frame in frames for name in names]


LICENSES: dict[str, list[str]] = {
    "MIT": [_MIT_BODY, f"MIT License\n\n{_MIT_BODY}", f"The MIT License (MIT)\n\n{_MIT_BODY}", *_notices("MIT", "MIT License")],
    "ISC": [_ISC_BODY, f"ISC License\n\n{_ISC_BODY}", *_notices("ISC", "ISC License")],
    "BSD-2-Clause": [_BSD_2 + _BSD_END, f"BSD 2-Clause License\n\n{_BSD_2}{_BSD_END}", *_notices("BSD-2-Clause", "BSD 2-Clause License")],
    "BSD-3-Clause": [_BSD_2 + _BSD_3 + _BSD_END, f"BSD 3-Clause License\n\n{_BSD_2}{_BSD_3}{_BSD_END}", *_notices("BSD-3-Clause", "BSD 3-Clause License")],
    "Apache-2.0": [_APACHE_NOTICE, *_notices("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License")],
    "GPL-3.0": [_GPL_NOTICE, *_notices("GPL-3.0-only", "GPL-3.0-or-later", "GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3")],
    "GPL-2.0": _notices("GPL-2.0-only", "GPL-2.0-or-later", "GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2"),
    "LGPL-3.0": _notices("LGPL-3.0-only", "LGPL-3.0-or-later", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3"),
    "MPL-2.0": _notices("MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "CC0-1.0": _notices("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": _notices("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": _notices("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": _notices("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": _notices("CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}

#: md5 of both canonical forms (notices of a line, notices over lines) of entire texts that are too long to stand here, as in Debian's /usr/share/common-licenses: with what follows "END OF TERMS AND CONDITIONS", and up to it.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["184d4af64a58c708bcf4cb2468396a96", "8d99569c7b33d2f613388e7f7b6676c3"],
    "Artistic-1.0-Perl": ["a8b0fb0c6e43a3b36bdc159e59dbfd1e"],
    "CC0-1.0": ["dcb3226ed1c311f82507296410434b55"],
    "GFDL-1.2": ["c969fdb4b731dadf7173c1ffbe49a117", "249045de8751a52011a06f1b13b877ef"],
    "GFDL-1.3": ["eb6b86c0fad89753a5a36c484fa0ada2", "84f73aa3e7c0c953fe94ba9f9d3c570c"],
    "GPL-1.0": ["e5fd842fec56252356c4b59ff4c25396", "fc612179e94c9cb3923841860cfa9a4e", "dbf3c47f5a8f127e58d08cabc1ebb916", "3aecf3f85b2a7e1cf719c688a1c214fa"],
    "GPL-2.0": ["c8178c7747e0c4dc179d321519588c40", "cb1eb18b44b31180cc7a0abc196d0eb5", "68380dbeadb093b94ecf563db7312db7", "08fc7904273686408e9b590734de5b14"],
    "GPL-3.0": ["3b0dde2c42fd48066d699b996be97e73", "444f95dc767ede978b60cfb20fbd0bca"],
    "LGPL-2.0": ["74cf7fcef3b29a39165a795b2cad3a3a", "0a25d2aecfda735541d43229ff8080bd", "c396ba2f94537628797123bc12cd2d6e", "2ea042204e231b3b068b34aabcb576c6"],
    "LGPL-2.1": ["f998bc436710cfece156aaa84fd26dd4", "289ba0a8647a7ad2647bd232a2712184", "3054b3781b1af43f906dc753acad15ee", "779e2ace56e0d116674a950a1728889b"],
    "LGPL-3.0": ["b31b7335bc37919e8cdd79154e04d88d"],
    "MPL-1.1": ["0f0c1f60803aac0283d5423bdccdfcc4"],
    "MPL-2.0": ["47daab7b99aa07cc72294488182970a7"],
}
