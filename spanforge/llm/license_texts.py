"""Known licence texts and notices. Texts are given whole; names are SPDX identifiers where one exists."""

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_1_2 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_START = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies.\n\n"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n'
    "For more information, please refer to <https://unlicense.org>"
)
_WTFPL = (
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\n"
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n'
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)


def _gpl(version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.\n\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\n"
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


def _notices(*names: str) -> list[str]:
    """The usual one-line notices for the names of one licence."""
    starts = ("Licensed under the", "Licensed under", "Released under the", "Released under", "This work is licensed under the", "This work is licensed under", "This software is licensed under the", "Distributed under the")
    return [f"{start} {name}." for start in starts for name in names]


LICENSES: dict[str, list[str]] = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT, *_notices("MIT License", "MIT licence terms"), "SPDX-License-Identifier: MIT"],
    "BSD-2-Clause": [_BSD_START + _BSD_1_2 + _BSD_END, "BSD 2-Clause License\n\n" + _BSD_START + _BSD_1_2 + _BSD_END, *_notices("BSD 2-Clause License"), "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [_BSD_START + _BSD_1_2 + _BSD_3 + _BSD_END, "BSD 3-Clause License\n\n" + _BSD_START + _BSD_1_2 + _BSD_3 + _BSD_END, *_notices("BSD 3-Clause License"), "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": [_ISC_START + _ISC_NOTICE + _ISC_END, "ISC License\n\n" + _ISC_START + _ISC_NOTICE + _ISC_END, *_notices("ISC License"), "SPDX-License-Identifier: ISC"],
    "0BSD": [_ISC_START + ".\n\n" + _ISC_END, "Zero-Clause BSD\n\n" + _ISC_START + ".\n\n" + _ISC_END],
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB, *_notices("zlib License")],
    "Unlicense": [_UNLICENSE, *_notices("Unlicense")],
    "WTFPL": [_WTFPL],
    "Apache-2.0": [_APACHE_NOTICE, *_notices("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "SPDX-License-Identifier: Apache-2.0"],
    "GPL-2.0": [_gpl("2"), *_notices("GNU General Public License, version 2", "GNU General Public License v2.0"), "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": [_gpl("3"), *_notices("GNU General Public License, version 3", "GNU General Public License v3.0"), "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-3.0": [*_notices("GNU Lesser General Public License, version 3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", *_notices("Mozilla Public License, version 2.0")],
    "CC-BY-4.0": _notices("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": _notices("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": _notices("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": _notices("CC BY-NC-SA 4.0"),
    "CC-BY-ND-4.0": _notices("CC BY-ND 4.0"),
    "CC0-1.0": _notices("CC0 1.0", "CC0 1.0 Universal"),
    "all-rights-reserved": ["All rights reserved."],
}

#: SHA-256 of the canonical form of long texts: whole, without title, preamble, appendix or exhibits, however they are wrapped.
#: The texts are those of /usr/share/common-licenses of Debian.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "b86cc8f4ca3b78dc6187c66567d6089a5911bbe4537e1fa0d5d9c38ce1b3749e",
        "408d79782772308fe7ec4aeb2f0b2f9a28dcf9246ddcf0755c43e4d3fb4efa11",
        "cb0c3bd3124478210522e8c821ca588654ce01e22f49f7da61cfbc25668b8487",
        "086e581cfe5679fcadc2ee1f4e4e577fed68582bd6dd9e503442770cb65bc2fc",
        "b63e30878385e7f72d51f917df9b848486580df38ea8700dfd55b39ca7079257",
        "f782bbc3a5175cf828c2da74cf86ccd6bbfad04d443aa90daf761ec30057eef7",
        "874e3f2cf98eebd990cbe0e47a9a29a86e88aaf5f66561cdc86fe4fe780f73ed",
        "364a89b007e5a1e9311701f9c91994ecab0f812acc23dc6c61241406f24abecd",
        "3af8cbd994b04c28567f09466b902886820f5597712a509ab0707890c2e1e598",
        "7c2e8289ac9e39a0559a537cca83fa0584813416e51e1fd59c3bc339d60bd814",
        "6eb5bd309beec31f73468edbde523f2466dcd15cda73ca01ee9effa48530bb54",
        "ac7bd7e089f88be958691c4f8d0fea1a1892eef7d61b7a310e101d547b3852a2",
    ],
    "GPL-1.0": [
        "9f6185ed2aa24f98f7cb52ad068f704dbc9b5951a986f6275e8bd7264f5a1e94",
        "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b",
        "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb",
        "aecdcff3f590d98b063118405900b07d72191e6bc88e09a9375ea1eba62d0a87",
        "839ed6871e0cf12ec5e9569c63feec3582da283bd67a626fc8f1489019021776",
        "fe1873252d8745083e66d80464d2da16717163bb0602dbf3cb3feb012890731d",
        "66b9393217e655fb7c337375a9e8a4dff7fe9f751b85057f95bad34b7edbd309",
        "e930fb0779e7c3bb3d3ce08a14b60ef8b9297fd737f9fbd8337d75996ae4985e",
        "5041c6edc49d34f3cccdfc098081e5abe8a1e8d377730ce81c43e3c3f20fca99",
    ],
    "GPL-2.0": [
        "cbce2709938501365973cbd4ead85f2d060294a310770d39aac679365387074a",
        "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca",
        "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88",
        "27dca172b6c17f7f3a066d31079eff9a2e75d39664fbaf6ee8f8b7586c2b87b2",
        "85f8b10454f175f72b3b26408affb942e7d63794173cb26a7e456c8ac1b7e23d",
        "a94437b9d88da4c876b7f24826d67f8d272471a359e2ab7854a62e81d9c08463",
        "4537ee5366b67e414f4235da7df4e4f5f32dc28af12c89f0be37f4521590048c",
        "69da3f4eabbfbe9eee5464483b20baed123a4b12624331097a4428c49e2eb621",
        "1a6314df2f1b575a5d85b1f2449d90edf9085f748178b506230a46a4ff5075d2",
        "833a818b1e1b7329ecef82692fc79cde98a12213ee020e8e356a9c3be906c216",
        "404d0fa7f4182a1ff4dc62e3d60300708a2c69f97bdd7ecf6f6dbef608da7a09",
        "9759758b719d71439c7e148750040c0c535582e6bf4835b91fafd81799da13ce",
    ],
    "GPL-3.0": [
        "826f46a485ae3ded4f243bebe658a26a4fb54fcf2467f8848117918212679d02",
        "57f71ba95bda9ddb21fcd4d2b6841fdc3ef7fcebd5c12a2fd2ee5f2027869fc6",
        "5b8bbbc08610f585b26c4d45ec4c46b3a401532b9362524e72b89d9db72bcb4f",
        "e7cac810f773133134b45e83e20cedf82b661b3f347310ca43ef698256922d3e",
        "9f2a3930410e05d0fba107cc24bef3addad154f3d49827e7e9bd7db77a4f2c93",
        "e127b2a2825044603df355ea7af3db35928974d380c65bf1ef34326b727cfee8",
        "4c2843fc1504208702c00e62a3c7a7be9d65b91e9f5cfca3527ec97000420123",
        "95bfc248ab628e2c1fffd4fa12d62559bcdfb8cf4fd29f45c86e899031441101",
        "e5304cda005d381ea567538753c6880a7dfe3d3a92c5a95e7c2878cf5748231c",
        "7c01e480dca2ddfe606104f1ae6090020840437a069515d7c010b66ff4df7d46",
        "e7ee04a39f782791e82bcef9d49f85a95ce23ceaa5b9f2aafcdaf6601f7800d2",
        "e83bdb118c292e013f64ea7c059882875c281e9cc5cd3b6e912422f3646e009c",
    ],
    "LGPL-2.0": [
        "ca88a167d481bc99831aab1ae52903c7b926ac8e49bd138ceb9213fd167eda81",
        "5b76795361ffca92776bfb6f87f31cc8c230526d08f639d965de248bd171ca59",
        "02fd8287939a10c62ed7dfb331733c7873c728e1fed2a3e9a79e8cf81c9fe955",
        "e40fbc9071cda786ae6b416a13d7d6f8cce6dea51fe9d5d87d8309a54226c63a",
        "f33db834104a51d233a7c44f16bb0432dade1ccb04c9b62b95286985c24f36cb",
        "df0df71bba04c47722dec6a96632550c38eae1108a14a18125d7bfb9bb2b59b6",
        "3b690f9766d0146bc75b9d22930e70884d860e725e9608139c965b530d1a0baf",
        "4d0b0fef0ea944d47de52ed05598ca7cf2c2cfb278d7ec31c4e0d5b410dd8e77",
        "964425fe40e23d9342c1ea2abca7dc8dcc18c4c11fef46008e312227e6d44821",
        "98d31c6d7f2e66c2767b9427c026f85c7f87eb88ee04742a481bf32d78d890b3",
        "8f77445973d45bd545ce8b76921f8a6684bf3fd0d58a65fb332d82d2937d5f09",
        "40e384747a9e76b605bb12aa01ab5104224cfa39d22cef39c3878017b334dfc9",
    ],
    "LGPL-2.1": [
        "ede2b00a7c3823a62ef837da1b2e848d4151187ba307a2f23aebaeebbc80bf7c",
        "e8fff5aab68f3784c88bdf6c7d677d555dbfc3274d7e0a03da4870604bf989ed",
        "f71ed154dfc5ed428b3389d785fc8ae6e6cde015405891fcbaec797514b833a0",
        "6d4456e69542b0bdfe55a1e5ff3d5510c6f1c070d4be28bc8f0616b757eacd8a",
        "8d5b84a8562d7a52a0562dced4db7500e4e40b068bc3d29c20c9a32af88ec26e",
        "f0a7add247e0ff2efb549f787aab73d27e54a5bb29bbed7827ab5206e470e149",
        "393e1ddbb6239de173446a892723995c0cd79699199438bd3d80a5cb24e3d747",
        "6a05654e8516c08f53dd79eda8dc6f64ec5cb0edb335dd7b4f468814f6370121",
        "1cdacd682eb34b74ad106f110259926fb3a831815ab055d05d8a45cb344151d8",
        "0534f6e027184060b0944744471f13e1c620d6a826b023889e7957c2018179c4",
        "1bb278c3128e4c5c64570bd84130b0cdee36b000b586b864fa8eef5d317de90e",
        "54c77963e266095f5fe970713f7518c08f5cb858fc31c829ade808d60b304ff9",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
        "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765",
        "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a",
    ],
    "MPL-1.1": [
        "f1daf3234686278093cf1137babd0598754ada714f0fc44e06e080008f7c6b38",
        "92aaf1fc5b066f9ba2e811c7fee8120509ba91288bba593ed94ab9a7e3616e55",
        "f7edac59b34c646c6e42446ec9860cbb611d0f4502d4ded414ec07127ffd1f3b",
        "409bb188d198332a8024e75ddf9f39ae565125f2ff79271ca93472de417c8ece",
    ],
    "MPL-2.0": [
        "4cabe7a78fd77da2d52b1a2929bf10219e45cfc14279d76a49774370a74b3d17",
        "8d0eccad062958e31288b7e815bc76f95b5da53a66feb490c3b44cec5b07f538",
        "da79d8c581c2a42b486948b54a56ee2dd7a105d8eceaa4203dfe5e0433d433b3",
        "5c52293944b1cb21a22557fc5d6bf6a080a8e8d3d635e921f5727daf4bc1ae36",
        "30a43a476448743c8d4de4e8aab798503e303cfc7354a38ff0aa00fe94b19f74",
        "fda4ed4a13c86ab7ecdb336e9c08eeabee86d001d5c6c1553fffc9a22f5f2fd3",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
        "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32",
        "4f8ab63ace774f37529081c81e2730a88143bf70e67392bd3c3701bd0a175152",
    ],
    "GFDL-1.2": [
        "58b6ebdf2bd26f81dd551d8efda909bfbc8914ce77996a5c289c28616b91ceeb",
        "b42a0505cefe2091ed99b0f621f0b01f682de48f6ab6aff8e404557bca6d5bff",
        "1e14907aea6472fd04f34e9b7fc14056165f9e77a12b667db60e78b51299db30",
        "a13f2842d54dedc8298b8756a20aabaceb17571a2ac86f8fc770b9e0b0e8356a",
    ],
    "GFDL-1.3": [
        "c4f8ea2b5247ab1ff721ce8255137250d4c14f50a0fb68c00fd793f496ced65e",
        "7d0e9d3e3194e4314ea1200179cbe2a845f9c80b59ec444aed48e7eb87d8c5f8",
        "c1276123d4906da86eea1a4b8a994fec6835206514446b899a66bf0e9f14ba24",
        "cbc3dbca74660e987e1610bfe10106d400835a54e40b659f2ffea4448854e2e1",
    ],
    "Artistic-1.0": [
        "c9bcba9e70d36ab628a0944e717aa88f7b65f5755a9f3061c584801892429806",
        "fdeaa98e60b13d34bf2a01960e531c12ba712d4615fb37dd068eda36f31ae176",
        "ae7033a87da062313020a206981cbfe1d8b2e09881d8cb84f4c4441e0bda953b",
        "7e8dafe4b58c22056360b2dcf027988e2d8ad581e0504ec682b7b97779a646a6",
    ],
}
