"""Paragraphs that stand for licence families."""

# Customary notices and opening words of public licences, one
# paragraph each, by family. They are what the classifier learns and compares to.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of "
        "this software and associated documentation files (the \"Software\"), to deal in "
        "the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
        "this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under "
        "the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
        "You should have received a copy of the GNU General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under "
        "the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any "
        "later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under "
        "the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, "
        "are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific "
        "prior written permission.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, "
        "v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
        "one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose "
        "with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International "
        "License.",
        "Licensed under CC BY 4.0.",
        "Content is available under a Creative Commons Attribution license.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "Licensed under CC BY-NC 4.0.",
        "Content is available under a Creative Commons Attribution-NonCommercial license.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related "
        "or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "Dedicated to the public domain under the CC0 1.0 Universal dedication.",
    ),
    "Proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, "
        "or transmitted in any form or by any means without the prior written permission "
        "of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. "
        "Proprietary and confidential.",
        "Copyright 2020 the authors. All rights reserved.",
        "Copyright (c) 2021 the company. All rights reserved.",
        "All rights reserved.",
    ),
}

# Paragraphs about licences that no family above covers. They teach
# the classifier what a licence of unknown family looks like.
OTHER_LICENSES = (
    "Released under the terms of our own license.",
    "Licensed under the license below.",
    "This work is licensed under the following license, version 1.",
    "You may use this file under the license that came with it.",
    "Distributed under the same license as the package.",
    "Permission is granted to copy this file for private study only.",
    "Released under the Open Software License, version 3.",
    "Licensed under the European Union Public License, version 1.2.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Released under the Artistic License 2.0.",
    "Licensed under the Boost Software License, version 1.0.",
    "Released under the zlib license.",
    "Licensed under the Community Data License Agreement.",
    "Redistribution of this document is permitted without fee.",
    "SPDX-License-Identifier: LicenseRef-other",
    "Licensed under the Example license, version 7.",
    "Licensed under the Some Name License, version 1.1.",
    "Released under the Foundation license, version 4.",
    "Released under a custom license.",
)

# Prose that uses words of licences without being one.
PLAIN_TEXTS = (
    "The program was published by the foundation last year.",
    "You can use any version of the software at work.",
    "She lost her driving license and got a new one.",
    "The public library is free and open to any person.",
    "All copies of the file were lost in the fire.",
    "The work was done under difficult conditions.",
    "He has the right to be heard under the law.",
    "The above list is the source of the notice in the paper.",
    "They agreed to the terms of the sale in writing.",
    "No copyright law was changed by the new government.",
    "The documentation is distributed to all members of the project.",
    "Their permission to build was granted by the city.",
    "The commons were open to all, without restriction.",
    "A general of the army gave a public speech at the foundation.",
    "Creative work needs free time and attribution of the ideas.",
)

# Words too common to tell anything by themselves.
COMMON_WORDS = (
    "a", "an", "and", "any", "are", "as", "at", "be", "been", "by", "can", "for", "from",
    "has", "have", "if", "in", "is", "it", "its", "may", "no", "nor", "not", "of", "on",
    "one", "or", "other", "our", "shall", "should", "so", "that", "the", "their", "they",
    "this", "to", "was", "were", "which", "with", "without", "you", "your", "he", "she",
    "her", "his", "we", "what", "when", "who", "will", "would", "all", "s",
)
