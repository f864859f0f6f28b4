"""Main text of HTML pages from flat text blocks.

A page is cut into blocks at block-level tags. A block's features are its words and link density,
those of the blocks before and after it, and, as one more feature, its place: in the page's article,
on a page without one, or beside it. A decision tree, trained here on the small labelled table below,
says which blocks are the main text. What a page itself calls a menu, header, footer, notice, advert,
form or comment, by tag, role or whole class name, and what it does not show, has no blocks, whatever its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Their content is never text of the page.
SKIPPED_TAGS = frozenset("script style noscript template svg math title textarea select button iframe object canvas audio video datalist".split())
CONTENT_TAGS = frozenset(["article", "main"])
#: Not the page's text, whatever is inside.
SHUT_TAGS = frozenset("nav footer aside menu".split())
SHUT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr notice notices newsletter nav navbar navigation menu menus breadcrumb breadcrumbs footer related recommended comment comments commentlist disqus respond reply replies pagination pager".split())
#: Names of several words: these beginnings and ends.
SHUT_STARTS = tuple(f"{x}-" for x in "advert cookie cookies comment comments consent gdpr newsletter related sponsored".split())
SHUT_NAMES |= frozenset("ad-slot ad-container ad-banner ad-wrapper page-comments user-comments reader-comments".split()) | frozenset(f"{a}-{b}" for a in ("site", "page", "main", "top", "primary", "global") for b in ("nav", "navbar", "navigation", "menu", "footer"))
#: Not the page's text, but an article or main inside is.
CLOSED_TAGS = frozenset("header form dialog".split())
CLOSED_NAMES = frozenset("banner notification alert popup modal overlay subscribe signup login header masthead toolbar topbar share sharing social form search nav-menu share-buttons social-links search-form login-form".split()) | frozenset(f"{a}-header" for a in ("site", "page", "main", "top", "primary", "global"))
CLOSED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Names that also stand round running text; the words decide.
WEAK_NAMES = frozenset("sidebar sidebars widget widgets promo promotion".split()) | frozenset(f"{a}-sidebar" for a in ("site", "page", "main", "primary"))
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID_TAGS = frozenset("area base col embed img input link meta param source track wbr".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Labelled blocks: words, link density, words and link density before and after, place (see blocks), then 1 for main text.
LABELLED = (
    # In an article.
    (60, 0.0, 45, 0.0, 80, 0.0, 1, 1), (3, 0.0, 60, 0.0, 70, 0.0, 1, 1), (1, 0.0, 20, 0.0, 1, 0.0, 1, 1), (8, 0.0, 0, 0.0, 8, 0.0, 1, 1), (9, 0.0, 6, 0.0, 40, 0.0, 1, 1), (25, 0.3, 30, 0.0, 30, 0.1, 1, 1), (12, 0.5, 40, 0.0, 50, 0.0, 1, 1), (2, 0.0, 90, 0.0, 12, 0.2, 1, 1), (140, 0.02, 3, 1.0, 2, 0.0, 1, 1),
    (5, 0.0, 1, 1.0, 60, 0.0, 1, 1), (30, 0.0, 12, 0.0, 12, 0.0, 1, 1), (6, 0.0, 4, 0.0, 0, 0.0, 1, 1), (4, 1.0, 35, 0.0, 40, 0.0, 1, 1), (1, 1.0, 50, 0.0, 30, 0.0, 1, 1), (6, 1.0, 4, 0.0, 5, 0.0, 1, 1), (300, 0.0, 0, 0.0, 0, 0.0, 1, 1), (3, 1.0, 2, 1.0, 4, 1.0, 1, 1), (8, 1.0, 9, 1.0, 7, 1.0, 1, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 1), (5, 0.9, 4, 1.0, 6, 1.0, 1, 1), (12, 1.0, 10, 0.9, 11, 1.0, 1, 1), (2, 1.0, 40, 0.0, 3, 1.0, 1, 1), (6, 1.0, 2, 0.0, 5, 1.0, 1, 1), (4, 1.0, 70, 0.0, 5, 1.0, 1, 1), (5, 1.0, 6, 1.0, 60, 0.0, 1, 1), (7, 1.0, 5, 1.0, 0, 0.0, 1, 1), (3, 1.0, 4, 1.0, 3, 0.0, 1, 1),
    (2, 1.0, 3, 1.0, 30, 0.0, 1, 1), (2, 0.0, 60, 0.0, 6, 1.0, 1, 1), (1, 0.0, 80, 0.0, 4, 1.0, 1, 1), (3, 0.0, 30, 0.0, 8, 1.0, 1, 1), (5, 1.0, 30, 0.1, 25, 0.0, 1, 1), (9, 1.0, 45, 0.0, 0, 0.0, 1, 1), (3, 0.9, 12, 0.0, 60, 0.2, 1, 1), (40, 0.1, 5, 1.0, 60, 0.0, 1, 1), (55, 0.0, 40, 0.0, 5, 1.0, 1, 1),
    (28, 0.2, 70, 0.0, 3, 1.0, 1, 1), (4, 0.0, 8, 0.0, 8, 0.0, 1, 1), (30, 0.0, 55, 0.0, 112, 0.0, 1, 1), (8, 0.0, 8, 0.0, 59, 0.0, 1, 1), (2, 0.0, 20, 0.0, 54, 0.0, 1, 1), (12, 0.0, 10, 0.0, 24, 0.0, 1, 1), (9, 0.0, 8, 0.0, 150, 0.0, 1, 1), (40, 0.0, 16, 0.0, 33, 0.0, 1, 1), (9, 0.0, 168, 0.0, 11, 0.0, 1, 1),
    (19, 0.0, 5, 0.0, 11, 0.0, 1, 1), (10, 0.0, 12, 0.0, 40, 0.0, 1, 1), (6, 0.0, 6, 0.0, 9, 0.0, 1, 1), (51, 0.0, 19, 0.0, 8, 0.0, 1, 1), (30, 0.0, 56, 0.0, 33, 0.0, 1, 1), (6, 0.0, 9, 0.0, 6, 0.0, 1, 1), (33, 0.0, 10, 0.0, 273, 0.0, 1, 1), (64, 0.0, 15, 0.0, 28, 0.0, 1, 1), (10, 0.0, 9, 0.0, 28, 0.0, 1, 1),
    (12, 0.0, 60, 0.0, 9, 0.0, 1, 1), (10, 0.0, 10, 0.0, 81, 0.0, 1, 1), (64, 0.0, 6, 0.0, 77, 0.0, 1, 1), (31, 0.0, 19, 0.0, 2, 0.0, 1, 1), (5, 0.0, 5, 0.0, 134, 0.0, 1, 1), (67, 0.0, 8, 0.0, 8, 0.0, 1, 1), (77, 0.0, 63, 0.0, 162, 0.0, 1, 1), (124, 0.0, 38, 0.0, 114, 0.0, 1, 1), (24, 0.0, 14, 0.0, 41, 0.0, 1, 1),
    (43, 0.0, 42, 0.0, 8, 0.0, 1, 1), (10, 0.0, 78, 0.0, 14, 0.0, 1, 1), (4, 1.0, 3, 1.0, 5, 1.0, 1, 1), (2, 1.0, 2, 1.0, 2, 1.0, 1, 1), (7, 1.0, 6, 1.0, 8, 1.0, 1, 1), (10, 1.0, 9, 1.0, 12, 1.0, 1, 1), (5, 1.0, 7, 1.0, 20, 0.0, 1, 1), (6, 1.0, 8, 1.0, 0, 0.0, 1, 1), (4, 1.0, 3, 0.0, 6, 1.0, 1, 1),
    (3, 1.0, 2, 0.0, 4, 1.0, 1, 1), (6, 1.0, 40, 0.0, 50, 0.0, 1, 1), (2, 1.0, 25, 0.0, 60, 0.1, 1, 1), (8, 1.0, 20, 0.0, 10, 0.0, 1, 1), (4, 1.0, 50, 0.0, 45, 0.0, 1, 1), (5, 1.0, 8, 0.0, 9, 0.0, 1, 1), (2, 0.0, 50, 0.0, 5, 1.0, 1, 1), (1, 0.0, 40, 0.0, 3, 1.0, 1, 1), (3, 0.0, 70, 0.0, 7, 1.0, 1, 1),
    (2, 0.0, 25, 0.0, 9, 1.0, 1, 1), (60, 0.0, 50, 0.0, 6, 1.0, 1, 1), (35, 0.1, 30, 0.0, 2, 1.0, 1, 1), (20, 0.0, 45, 0.0, 4, 1.0, 1, 1), (80, 0.0, 6, 1.0, 40, 0.0, 1, 1), (12, 0.0, 4, 1.0, 70, 0.0, 1, 1), (8, 0.0, 3, 1.0, 60, 0.0, 1, 1), (3, 0.0, 2, 1.0, 40, 0.0, 1, 1), (6, 0.0, 4, 1.0, 80, 0.0, 1, 1),
    (2, 0.0, 3, 1.0, 25, 0.0, 1, 1), (4, 0.0, 5, 1.0, 50, 0.0, 1, 1), (7, 0.0, 2, 1.0, 15, 0.0, 1, 1), (1, 0.0, 2, 1.0, 9, 0.0, 1, 1), (3, 0.0, 3, 1.0, 1, 1.0, 1, 1),
    # On a page without one.
    (70, 0.0, 55, 0.0, 60, 0.0, 0, 1), (40, 0.05, 3, 1.0, 45, 0.0, 0, 1), (35, 0.1, 60, 0.0, 2, 1.0, 0, 1), (18, 0.0, 50, 0.0, 40, 0.0, 0, 1), (25, 0.2, 40, 0.0, 60, 0.0, 0, 1), (6, 0.0, 40, 0.0, 55, 0.0, 0, 1), (3, 0.0, 70, 0.0, 30, 0.0, 0, 1), (200, 0.0, 0, 0.0, 0, 0.0, 0, 1), (8, 0.0, 2, 1.0, 50, 0.0, 0, 1),
    (12, 0.0, 3, 1.0, 90, 0.0, 0, 1), (22, 0.0, 30, 0.0, 0, 0.0, 0, 1), (16, 0.0, 0, 0.0, 0, 0.0, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0), (9, 1.0, 8, 1.0, 60, 0.0, 0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0, 0), (6, 0.8, 50, 0.0, 5, 0.9, 0, 0), (30, 0.9, 3, 1.0, 20, 0.9, 0, 0),
    (4, 0.0, 3, 0.0, 2, 1.0, 0, 1), (5, 0.0, 2, 0.6, 3, 0.0, 0, 1), (2, 1.0, 1, 1.0, 3, 1.0, 0, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0, 0), (4, 1.0, 3, 1.0, 45, 0.0, 0, 0), (3, 1.0, 60, 0.0, 4, 1.0, 0, 0), (6, 0.9, 50, 0.0, 55, 0.0, 0, 0), (2, 1.0, 70, 0.0, 40, 0.0, 0, 0), (8, 0.8, 30, 0.0, 6, 1.0, 0, 0),
    (3, 0.0, 2, 1.0, 3, 1.0, 0, 0), (4, 0.0, 5, 0.0, 2, 1.0, 0, 1), (2, 0.0, 3, 0.0, 4, 0.0, 0, 1), (6, 0.0, 5, 1.0, 3, 0.0, 0, 1), (5, 0.0, 8, 0.7, 2, 0.0, 0, 1), (90, 0.0, 80, 0.0, 70, 0.0, 0, 1), (45, 0.1, 60, 0.0, 30, 0.1, 0, 1), (50, 0.0, 2, 1.0, 60, 0.0, 0, 1), (65, 0.0, 70, 0.0, 3, 1.0, 0, 1),
    (24, 0.0, 40, 0.0, 35, 0.0, 0, 1), (4, 0.0, 60, 0.0, 80, 0.0, 0, 1), (5, 0.0, 45, 0.0, 50, 0.0, 0, 1), (14, 0.0, 35, 0.0, 60, 0.0, 0, 1), (11, 0.0, 1, 1.0, 70, 0.0, 0, 1), (33, 0.2, 3, 1.0, 40, 0.0, 0, 1), (12, 0.0, 30, 0.0, 0, 0.0, 0, 1), (9, 0.0, 40, 0.0, 12, 0.0, 0, 1), (10, 0.0, 25, 0.0, 8, 0.0, 0, 1),
    (13, 0.0, 60, 0.0, 15, 0.0, 0, 1), (11, 0.0, 120, 0.0, 20, 0.0, 0, 1), (9, 0.0, 35, 0.0, 10, 0.0, 0, 1), (15, 0.0, 50, 0.0, 18, 0.0, 0, 1), (14, 0.1, 80, 0.0, 0, 0.0, 0, 1), (4, 0.0, 10, 0.0, 60, 0.0, 0, 1), (2, 0.0, 6, 0.0, 40, 0.0, 0, 1), (3, 0.0, 12, 0.0, 70, 0.0, 0, 1), (5, 0.0, 4, 1.0, 50, 0.0, 0, 1),
    (3, 0.0, 1, 1.0, 80, 0.0, 0, 1), (2, 0.0, 3, 1.0, 30, 0.0, 0, 1), (7, 0.0, 3, 0.7, 0, 0.0, 0, 1), (4, 0.6, 60, 0.0, 0, 0.0, 0, 0), (15, 0.7, 20, 0.0, 40, 0.0, 0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (2, 0.0, 0, 0.0, 5, 0.0, 0, 1), (5, 0.0, 2, 0.0, 9, 0.0, 0, 1), (9, 0.0, 5, 0.0, 0, 0.0, 0, 1), (2, 0.0, 0, 0.0, 60, 0.0, 0, 1), (2, 0.0, 80, 0.0, 45, 0.0, 0, 1), (3, 0.0, 2, 0.0, 4, 0.0, 0, 1), (1, 0.0, 30, 0.0, 1, 0.0, 0, 1), (12, 0.3, 20, 0.0, 10, 0.0, 0, 1), (4, 0.0, 1, 1.0, 30, 0.0, 0, 1),
    (2, 0.0, 1, 1.0, 6, 0.0, 0, 1), (1, 0.0, 4, 1.0, 12, 0.0, 0, 1), (6, 0.0, 8, 0.0, 2, 1.0, 0, 1), (3, 0.0, 50, 0.0, 1, 1.0, 0, 1), (1, 0.0, 1, 1.0, 1, 1.0, 0, 0), (2, 0.0, 2, 1.0, 3, 1.0, 0, 0), (1, 0.0, 3, 1.0, 2, 1.0, 0, 0), (4, 0.0, 2, 1.0, 2, 1.0, 0, 0), (3, 0.0, 6, 0.9, 4, 1.0, 0, 0),
    (7, 0.6, 3, 0.0, 4, 0.0, 0, 0), (1, 1.0, 0, 0.0, 0, 0.0, 0, 0), (4, 1.0, 0, 0.0, 5, 0.0, 0, 0), (2, 1.0, 60, 0.0, 0, 0.0, 0, 0), (10, 0.55, 4, 0.0, 9, 0.0, 0, 0), (25, 0.65, 30, 0.0, 10, 0.0, 0, 0),
    # Under a weak name of furniture, or beside the article.
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 0), (2, 1.0, 1, 1.0, 8, 0.0, -1, 0), (7, 0.0, 1, 1.0, 9, 0.0, -1, 0), (12, 0.0, 60, 0.0, 0, 0.0, -1, 0), (45, 0.0, 8, 0.0, 50, 0.0, -1, 0), (120, 0.0, 60, 0.0, 90, 0.0, -1, 0), (20, 0.2, 100, 0.0, 0, 0.0, -1, 0), (5, 0.4, 0, 0.0, 40, 0.0, -1, 0), (15, 0.0, 15, 0.0, 15, 0.0, -1, 0),
    (3, 0.0, 2, 1.0, 70, 0.0, -1, 0), (70, 0.1, 70, 0.0, 6, 0.0, -1, 0), (30, 0.0, 1, 0.0, 2, 1.0, -1, 0), (150, 0.0, 120, 0.0, 140, 0.0, -1, 1), (130, 0.02, 150, 0.0, 110, 0.0, -1, 1), (180, 0.0, 110, 0.0, 125, 0.0, -1, 1), (140, 0.0, 130, 0.0, 3, 0.0, -1, 1), (160, 0.05, 140, 0.0, 115, 0.02, -1, 1), (145, 0.0, 4, 0.0, 135, 0.0, -1, 1),
    (150, 0.8, 120, 0.0, 140, 0.0, -1, 0), (160, 0.9, 130, 0.9, 140, 0.8, -1, 0), (145, 0.7, 20, 1.0, 3, 0.0, -1, 0), (16, 0.0, 8, 0.0, 0, 0.0, -1, 0), (1, 1.0, 1, 1.0, 8, 0.0, -1, 0), (15, 0.0, 10, 0.0, 0, 0.0, -1, 0), (1, 1.0, 1, 1.0, 1, 1.0, -1, 0), (1, 1.0, 1, 1.0, 5, 0.0, -1, 0), (11, 0.0, 11, 0.0, 0, 0.0, -1, 0),
    (15, 0.0, 5, 0.0, 0, 0.0, -1, 0), (1, 1.0, 1, 1.0, 11, 0.0, -1, 0), (12, 0.0, 28, 0.0, 0, 0.0, -1, 0), (1, 1.0, 1, 1.0, 9, 0.0, -1, 0), (10, 0.0, 1, 1.0, 10, 0.0, -1, 0), (1, 1.0, 1, 1.0, 13, 0.0, -1, 0), (9, 0.0, 21, 0.0, 0, 0.0, -1, 0), (5, 0.0, 1, 1.0, 8, 0.0, -1, 0), (5, 0.0, 1, 1.0, 10, 0.0, -1, 0),
    (12, 0.0, 6, 0.0, 0, 0.0, -1, 0), (10, 0.0, 1, 1.0, 12, 0.0, -1, 0), (5, 0.0, 1, 1.0, 9, 0.0, -1, 0), (11, 0.0, 1, 1.0, 9, 0.0, -1, 0), (1, 1.0, 1, 1.0, 10, 0.0, -1, 0), (14, 0.0, 38, 0.0, 0, 0.0, -1, 0), (9, 0.0, 1, 1.0, 10, 0.0, -1, 0), (7, 0.0, 5, 0.0, 0, 0.0, -1, 0), (13, 0.0, 12, 0.0, 0, 0.0, -1, 0),
    (135, 0.0, 145, 0.0, 150, 0.0, -1, 1), (170, 0.0, 130, 0.0, 140, 0.0, -1, 1), (155, 0.01, 125, 0.0, 160, 0.0, -1, 1), (200, 0.0, 150, 0.0, 5, 0.0, -1, 1), (165, 0.0, 5, 0.0, 145, 0.0, -1, 1), (190, 0.02, 170, 0.0, 180, 0.0, -1, 1), (150, 0.75, 130, 0.0, 140, 0.0, -1, 0), (140, 0.85, 150, 0.8, 130, 0.8, -1, 0), (160, 0.7, 3, 1.0, 4, 0.0, -1, 0),
    (170, 0.95, 10, 0.0, 5, 0.0, -1, 0), (100, 0.0, 60, 0.0, 70, 0.0, -1, 0), (90, 0.0, 80, 0.0, 50, 0.0, -1, 0), (110, 0.0, 40, 0.0, 30, 0.0, -1, 0), (105, 0.1, 90, 0.0, 80, 0.0, -1, 0), (14, 0.0, 150, 0.0, 0, 0.0, -1, 0), (9, 0.0, 400, 0.0, 0, 0.0, -1, 0), (17, 0.0, 130, 0.0, 0, 0.0, -1, 0), (12, 0.0, 220, 0.0, 6, 0.0, -1, 0),
    (6, 0.0, 180, 0.0, 9, 0.0, -1, 0), (20, 0.1, 600, 0.0, 0, 0.0, -1, 0), (8, 0.0, 125, 0.0, 3, 0.0, -1, 0), (11, 0.0, 160, 0.0, 12, 0.0, -1, 0),
)


#: Inside an element that is not shown, or shut for good; inside one that only an article opens. Neither has blocks.
SHUT, CLOSED = -3, -2
#: Inside a form that was opened before any text: it may be round the whole page.
AROUND = 2


#: Elements without text of the page that a page may leave open; what follows an open one is text.
_OFTEN_OPEN = re.compile(r"<(/?)(button|select|noscript|object|canvas|audio|video|datalist|template)\b[^>]*>", re.IGNORECASE)


def without_open(html: str) -> str:
    """html without start tags of such elements that no end tag closes."""
    waiting: dict[str, list[tuple[int, int]]] = {}
    for m in _OFTEN_OPEN.finditer(html):
        mine = waiting.setdefault(m[2].lower(), [])
        if not m[1]:
            mine.append(m.span())
        elif mine:
            mine.pop()
    parts, at = [], 0
    for start, end in sorted(x for mine in waiting.values() for x in mine):
        parts.append(html[at:start])
        at = end
    return "".join(parts) + html[at:]


def _hidden(attrs: dict) -> bool:
    return "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or bool(_HIDDEN.search((attrs.get("style") or "").lower()))


class _Blocks(HTMLParser):
    """Flat text blocks: [text, words in links, place]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, int]] = []  # open block-level elements, each with the place inside it
        self.open: Counter[str] = Counter()  # how many of each tag the stack has
        self.skip: list[str] = []
        self.unseen: list[str] = []  # an inline element that is not shown, and those of its name within
        self.link = False
        self.parts: list[str] = []
        self.linked = 0

    @property
    def place(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and self.place > CLOSED:
            self.blocks.append((text, self.linked, self.place))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag in SKIPPED_TAGS:
            self.skip.append(tag)
            self.parts.append(" ")
        elif tag == "br":
            self.parts.append(" ")
        elif tag in BLOCK_TAGS:
            self.flush()
            self.link = False
            self.unseen.clear()  # a block ends an inline element left open
            if tag == "hr":
                return
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd") and self.stack and self.stack[-1][0] == tag:
                self.open[self.stack.pop()[0]] -= 1  # an end tag that may be left out
            self.stack.append((tag, self.within(tag, dict(attrs))))
            self.open[tag] += 1
        elif self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.append(tag)
        elif tag not in VOID_TAGS and _hidden(dict(attrs)):
            self.unseen.append(tag)
        elif tag == "a":
            self.link = True

    def within(self, tag: str, attrs: dict) -> int:
        outer = self.place
        if outer == SHUT or _hidden(attrs):
            return SHUT
        names = {x for key in ("class", "id") for x in (attrs.get(key) or "").lower().replace("_", "-").split()}
        if tag in ("html", "body"):
            return outer
        title = outer == 1 and (tag in HEADINGS or tag == "header")  # an article's own
        if tag in SHUT_TAGS or not title and (names & SHUT_NAMES or any(x.startswith(SHUT_STARTS) for x in names)):
            return SHUT
        if tag in CONTENT_TAGS:
            return 1
        if tag == "form" and not self.blocks and all(t in ("html", "body") for t, _ in self.stack):
            return AROUND
        if not title and (tag in CLOSED_TAGS or names & CLOSED_NAMES or (attrs.get("role") or "").lower() in CLOSED_ROLES):
            return CLOSED
        return -1 if names & WEAK_NAMES and outer > CLOSED and not title else outer

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in BLOCK_TAGS:
            self.flush()
            self.link = False
            self.unseen.clear()
            if self.open[tag]:
                while (last := self.stack.pop()[0]) != tag:
                    self.open[last] -= 1
                self.open[tag] -= 1
        elif self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
        elif tag == "a":
            self.link = False

    def handle_data(self, data):
        if not self.skip and not self.unseen:
            self.parts.append(data)
            if self.link:
                self.linked += len(data.split())


def blocks(html: str | None) -> list[tuple[str, int, int]]:
    """(text, words in links, place): place is 1 in an article, 0 on a page without one, -1 beside it or under a weak name."""
    html = html or ""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"<[A-Za-z/!?]", html[cut:]):
        html = html[:cut]  # a page cut off inside a tag
    parser = _Blocks()
    parser.feed(without_open(html))
    parser.close()
    parser.flush()
    places = {place for _, _, place in parser.blocks}
    beside = -1 if 1 in places else 0
    # A form is the page if nothing but it has text.
    return [(text, linked, beside if place in (0, AROUND) else place) for text, linked, place in parser.blocks if place != AROUND or places == {AROUND}]


def features(found: list[tuple[str, int, int]]) -> list[tuple[float, ...]]:
    own = []
    for text, linked, _ in found:
        n = len(text.split())
        own.append((n, min(1.0, linked / n) if n else 0.0))
    none = (0, 0.0)
    return [(*own[k], *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none), found[k][2]) for k in range(len(found))]


def grow(rows, depth: int = 6):
    """A decision tree by Gini impurity: a class, or (feature, limit, not above, above)."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            limit = (a + b) / 2
            low, high = [r for r in rows if r[f] <= limit], [r for r in rows if r[f] > limit]
            gini = sum(len(x) * (p := sum(r[-1] for r in x) / len(x)) * (1 - p) for x in (low, high))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, limit, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


@lru_cache(maxsize=1)
def tree():
    return grow(LABELLED)


def is_content(row: tuple[float, ...]) -> bool:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node == 1


def main_text(html: str | None) -> str:
    """The main text: blocks in page order, white space within one made one space, joined by an empty line."""
    found = blocks(html)
    return "\n\n".join(b[0] for b, row in zip(found, features(found), strict=True) if is_content(row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html; the rest is not read).

    Null, empty and text-less pages have an empty text. Broken and cut off mark-up is read as far as
    it goes; nothing is cut by length. Repeated rows and null ids stay as they are, and no other column
    is read, so none can clash. An empty table gives an empty result.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype="object")

    out = pages.select("page_id", "url", F.pandas_udf(run, "string")(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
