"""A page format for tests: pages apart by form feeds; a file that is opened leaves a mark."""

import os
import re
import tempfile

MARKS = f"{tempfile.gettempdir()}/lectern-opened-pages"


class Pages:
    def count(self, content):
        return content.count(b"\f") + 1

    def pages(self, content, first, last):
        os.makedirs(MARKS, exist_ok=True)
        name = re.sub(r"\W", "", content[:12].decode())
        with open(f"{MARKS}/{name}-{first}-{last}", "w"):
            pass
        for n, page in enumerate(content.decode().split("\f"), 1):
            if first <= n <= last:
                yield {"page_num": n, "native_text": page, "ocr_text": f"ocr {n}", "n_columns": 2, "significant": n == 2, "item": f"{name}{n}"}
