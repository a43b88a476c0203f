"""Texts of licences and of the notices that name them, by SPDX id.

Copyright lines are not part of them; the canonical form drops such lines.
"""

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

BSD_3 = BSD_2.replace(
    "THIS SOFTWARE IS PROVIDED",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED",
    1,
)

ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ISC = ZERO_BSD.replace(
    "is hereby granted.",
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    1,
)

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

# How a notice of one line names a licence.
_NAMES = {
    "MIT": ("the MIT License", "the MIT license (MIT)", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"),
    "GPL-3.0-only": ("the GNU General Public License, version 3", "the GNU GPL, version 3", "GPL-3.0-only"),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "the GNU GPL, version 2", "GPL-2.0-only"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "BSD-3-Clause"),
    "ISC": ("the ISC License", "ISC"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
}
_FORMS = (
    "Released under {}.", "Licensed under {}.", "Distributed under {}.", "This work is licensed under {}.",
    "This software is licensed under {}.", "SPDX-License-Identifier: {}",
)

LICENSES: dict[str, list[str]] = {i: [form.format(n) for n in names for form in _FORMS] for i, names in _NAMES.items()}
for _id, _text in {
    "MIT": MIT, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3, "0BSD": ZERO_BSD, "ISC": ISC, "Zlib": ZLIB,
    "Unlicense": UNLICENSE, "Apache-2.0": APACHE_HEADER, "GPL-3.0-or-later": GPL_HEADER,
}.items():
    LICENSES.setdefault(_id, []).append(_text)
    if _text.startswith("MIT License"):
        LICENSES[_id].append(_text.removeprefix("MIT License"))

# SHA-256 of the canonical form of full texts.
FULL_TEXTS: dict[str, str] = {
    "Apache-2.0": "4eaa899d32a2c1d64a04df98845e9b21a17d46c603b95cbcf3436c2f30e94072",
    "Artistic-1.0-Perl": "684aa9b9142b709275bcd9a7ed27a50a8fd5049107119461bff21e5da785e6a6",
    "CC0-1.0": "800493f592b487dc071302432bfec79e4f0175c89e637223ee87640054e704a1",
    "GFDL-1.2-only": "33b57251a1a3c1951cda19a08842abeffe76def37b3a7680f690bac217059fc6",
    "GFDL-1.3-only": "4ada558caa5584e86798224618a58c88e1d7d20401f17270d93140ff03cd3f22",
    "GPL-1.0-only": "0fd26cb357b16bef21ebe6d83f5690a528d8d143cf6a48d6a01c258f4d56e79a",
    "GPL-2.0-only": "a5f0230a2074b101fa202aafa0ad9541eea58f6bc874c4c220bda09f8c82e3e9",
    "GPL-3.0-only": "a4950adabdc0f84a7deb14ce05cb03037504755e112dd883812833ebc001e3e4",
    "LGPL-2.0-only": "928af3da7360eee9e53bed5c74b1d7685a4c6877e0811bcc979a9c13d72b4d60",
    "LGPL-2.1-only": "a6888b9c7fe5d5d98db6a550afc6a363c815eaba67767b1d1842c31cc2d552bf",
    "LGPL-3.0-only": "db9c4385408d27d4231fa798f32a7463c978e05a5d1e8ded7d665c6e5d0005d6",
    "MPL-1.1": "14b9486ef11fdc8f2461e0f5abf9af560cf58d159c70678a002ba6b89e8988a5",
    "MPL-2.0": "c68f4e1d80c0f53b18cfa29cf75087e617254cb8cab2d053ab420fb2af78b072",
}
