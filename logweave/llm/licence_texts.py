"""Licence notices as they stand in files: headers, grants and conditions, with the phrases that must be there."""

from __future__ import annotations

# Fixed values: (label, notice, mandatory key phrases in the order in which they stand). Case and punctuation don't count.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", ["Permission is hereby granted, free of charge", "to deal in the Software without restriction"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ["Permission is hereby granted, free of charge", "to deal in the Software without restriction"]),
    ("mit", "Released under the MIT License", ["released under the MIT License"]),
    ("mit-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\"", ["Permission is hereby granted, free of charge", "is furnished to do so. THE SOFTWARE IS PROVIDED"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["Licensed under the Apache License, Version 2.0"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["Licensed under the Apache License, Version 2.0"]),
    ("apache-2", "licensed to you under the Apache License, Version 2.0", ["under the Apache License, Version 2.0"]),
    ("gpl-3", "licensed under the GNU General Public License version 3", ["GNU General Public License", "version 3"]),
    ("gpl-2", "licensed under the GNU General Public License version 2", ["GNU General Public License", "version 2"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["under the terms of the GNU General Public License", "version 3 of the License"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["under the terms of the GNU General Public License", "version 2 of the License"]),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation; version 3 of the License", ["GNU General Public License", "version 3 of the License"]),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License", ["GNU General Public License", "version 2 of the License"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["GNU Lesser General Public License"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GNU Lesser General Public License", "version 3 of the License"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["GNU Lesser General Public License", "version 2.1 of the License"]),
    ("lgpl", "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License", ["GNU Library General Public License", "version 2 of the License"]),
    ("agpl", "licensed under the GNU Affero General Public License", ["GNU Affero General Public License"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["GNU Affero General Public License", "version 3 of the License"]),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", ["GNU Free Documentation License"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ["Redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["Redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software without specific prior written permission"]),
    ("bsd-4", "All advertising materials mentioning features or use of this software must display the following acknowledgement", ["All advertising materials mentioning features or use of this software must display the following acknowledgement"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["Permission to use, copy, modify, and/or distribute this software", "with or without fee is hereby granted, provided that"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["Permission to use, copy, modify, and/or distribute this software", "with or without fee is hereby granted"]),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\"", ["Permission to use, copy, modify, and/or distribute this software", "with or without fee is hereby granted. THE SOFTWARE"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["subject to the terms of the Mozilla Public License, v. 2.0"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["Mozilla Public License, v. 2.0"]),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.", ["subject to the Mozilla Public License Version 1.1"]),
    ("mpl-1.1", "subject to the Mozilla Public License Version 1.1", ["subject to the Mozilla Public License Version 1.1"]),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0", ["under the terms of the Eclipse Public License", "2.0"]),
    ("epl-1", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", ["under the terms of the Eclipse Public License v1.0"]),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.", ["subject to the terms of the Common Development and Distribution License"]),
    ("cddl", "subject to the terms of the Common Development and Distribution License", ["terms of the Common Development and Distribution License"]),
    ("cpl", "made available under the terms of the Common Public License v1.0", ["under the terms of the Common Public License"]),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0.", ["Boost Software License, Version 1.0"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ["Permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["free and unencumbered software released into the public domain"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"]),
    ("artistic-2", "This package is free software; you may redistribute it and/or modify it under the terms of the Artistic License 2.0", ["under the terms of the Artistic License 2.0"]),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", ["SIL Open Font License, Version 1.1"]),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice", ["without fee, and without a written agreement is hereby granted"]),
    ("psf", "This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software", ["is between the Python Software Foundation"]),
    ("ncsa", "to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["to deal with the Software without restriction"]),
    ("eupl", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");", ["Licensed under the EUPL"]),
    ("ms-pl", "This license governs use of the accompanying software. Microsoft Public License (Ms-PL)", ["Microsoft Public License"]),
    ("afl-3", "Licensed under the Academic Free License version 3.0", ["Academic Free License version 3.0"]),
    ("osl-3", "Licensed under the Open Software License version 3.0", ["Open Software License version 3.0"]),
    ("cecill", "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software.", ["governed by the CeCILL", "under French law"]),
    ("odbl", "is made available under the Open Database License", ["made available under the Open Database License"]),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", ["dedicated all copyright and related and neighboring rights", "to the public domain worldwide"]),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ["CC0 1.0 Universal"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["Creative Commons Attribution 4.0"]),
    ("cc-by", "available under the Creative Commons Attribution 3.0 License", ["Creative Commons Attribution 3.0"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["Creative Commons Attribution-ShareAlike 4.0"]),
    ("cc-by-sa", "available under the Creative Commons Attribution-ShareAlike 3.0 License", ["Creative Commons Attribution-ShareAlike 3.0"]),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["Creative Commons Attribution-NoDerivatives 4.0"]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["Creative Commons Attribution-NonCommercial 4.0"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["CC BY-NC", "4.0"]),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0"]),
    ("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"]),
]
