"""The labelled table from which the extraction tree is trained: pages whose main blocks are marked.

``data-main`` marks a block of main text.  ``$9`` stands for nine words of
filler, ``$9.`` for a sentence of as many.
"""

from __future__ import annotations

import re

_FILLER = "lorem ipsum dolor sit amet elit sed magna aliqua enim minim quis nisi duis aute irure velit".split()

_PAGES = [
    # Articles in elements of their own, with short and long paragraphs.
    """<header><a href=/>$2</a><h2>$3</h2><p>$5</p></header><nav><ul><li><a href=a>$1</a><li><a href=b>$2</a><li><a href=c>$1</a></ul></nav>
    <article><h1 data-main>$6</h1><p data-main>$45.</p><p data-main>$1.</p><p data-main>$3.<p data-main>$60.</p><h2 data-main>$2</h2><p data-main>$8.</p></article>
    <footer>$2 <a href=d>$1</a> $4.</footer>""",
    """<nav><a href=a>$1</a> <a href=b>$1</a></nav><div class=ad>$14.</div><article><h1 data-main>$9</h1><p data-main><b>$12.<br><p data-main>$30.</p><p data-main>$2.</p></article>
    <footer>$12. $9.</footer>""",
    """<div class="ad banner"><p>$30.</p></div><main><h1 data-main>$4</h1><p data-main>$20.</p><ul><li data-main>$4<li data-main>$11.<li data-main>$2</ul><p data-main>$25.</p>
    <div class=advert>$9.</div><p data-main>$18.</p></main><aside><h3>$2</h3><p>$22.</p><ul><li><a href=a>$5</a></ul></aside><footer><p>$20.</p></footer>""",
    """<article><header><h1 data-main>$7</h1><p>$4</p></header><p data-main>$33.</p><blockquote data-main>$15.</blockquote><p data-main>$5.</p><figure><figcaption data-main>$8.</figcaption></figure>
    <div class=share><a href=a>$1</a> <a href=b>$1</a></div><section id=comments><h3>$2</h3><div class=comment><p>$25.</p></div><div class=comment><p>$3.</p></div></section></article>
    <div class="newsletter signup"><p>$15.</p><form><label>$1</label><button>$1</button></form></div>""",
    """<div class=cookie-notice><p>$26. <a href=a>$2</a></p><button>$1</button></div><main><article><h1 data-main>$5</h1><p data-main>$3.</p><p data-main>$44. <a href=c>$2</a> $9.</p>
    <pre data-main>$12</pre><p data-main>$28.</p></article><section class=related><h2>$2</h2><article><h3><a href=x>$6</a></h3><p>$15.</p></article><article><h3><a href=y>$7</a></h3><p>$12.</p></article></section></main>""",
    """<div role=banner><h1>$2</h1></div><div role=navigation><a href=a>$1</a></div><div role=main><h2 data-main>$6</h2><p data-main>$40.</p><p data-main>$1</p><table><tr><td data-main>$2<td data-main>$6<tr><td data-main>$1<td data-main>$14.</table></div>
    <div role=complementary><p>$19.</p></div><div role=contentinfo>$15.</div>""",
    """<article><h1 data-main>$3</h1><p data-main>$2.</p></article><footer>$11.</footer>""",
    """<nav><li><a href=a>$1</a></nav><article><p data-main>$4</p></article><footer>$3</footer>""",
    """<article><h1 data-main>$8</h1><p data-main>$90.</p><p data-main>$70.</p><p class=disclaimer>$40.</p></article><article class=comment><h4>$2</h4><p>$50.</p></article>
    <div hidden><p>$30.</p></div><p>$9.</p>""",
    """<article><p data-main>$16.</p><p data-main><a href=a>$9</a></p><p data-main>$1.</p><ul><li data-main><a href=b>$4</a><li data-main><a href=c>$3</a></ul><p data-main>$21.</p>
    <nav><a href=a>$3</a></nav></article><p>$12.</p>""",
    """<header><a href=/>$2</a></header><article class=post><header><h1 data-main>$9</h1><p>$3</p></header><p data-main>$36.</p><p data-main>$4</p></article><footer><h4>$2</h4><p>$20.</p></footer>""",
    """<header><h1>$3</h1><nav><a href=a>$1</a></nav></header><main><article><header><h2 data-main>$7</h2><span>$4</span></header><div data-main>$27.</div><footer>$6</footer></article></main>""",
    """<article><header><h1 data-main>$2</h1></header><p data-main>$16.</p><aside><h2>$3</h2><p>$30.</p></aside><p data-main>$41.</p><section class=comments><h2>$2</h2><h3>$1</h3><p>$18.</p></section></article>""",
    """<article><header><h1 data-main>$11</h1><p>$5.</p></header><p data-main>$23.</p><aside><h2>$9</h2><p>$15.</p></aside></article><aside><h2>$8</h2><p>$31.</p></aside><footer><h3>$10</h3><p>$9.</p></footer>""",
    """<header><h2>$9</h2></header><nav><h2>$7</h2><ul><li><a href=a>$1</a></ul></nav><main><h1 data-main>$3</h1><p data-main>$13.</p></main><form><h3>$8</h3><p>$12.</p></form>""",
    # Containers that only their class or id names.
    """<div id=topnav><ul><li><a href=a>$1</a><li><a href=b>$1</a></ul></div><div id=content><h1 data-main>$5</h1><p data-main>$37.</p><p data-main>$4.</p><h3 data-main>$3</h3><p data-main>$22.</p></div>
    <div id=sidebar><h3>$2</h3><p>$24.</p></div><div id=footer><p>$18.</p></div>""",
    """<div class=masthead><p>$6</p></div><div class=post-body><p data-main>$2.</p><p data-main>$19.</p><div class=promo><p>$13.</p></div><p data-main>$31.</p></div>
    <div id=disqus_thread><p>$40.</p><p>$9.</p></div><div class=pagination><a href=a>$1</a> <a href=b>$1</a></div>""",
    """<div class="breadcrumb"><a href=a>$1</a> <a href=b>$2</a></div><div class="entry-content"><h2 data-main>$6</h2><p data-main>$55.</p><ol><li data-main>$9.<li data-main>$3.</ol></div>
    <div class="related-posts"><p>$11.</p></div><div class=login><form><p>$5</p></form></div>""",
    """<section class=story><h1 data-main>$4</h1><p data-main>$29.</p><p data-main>$6</p></section><section class=popular><h2>$2</h2><ol><li><a href=a>$8</a><li><a href=b>$7</a></ol></section><div class=copyright>$9.</div>""",
    # Layouts without any name: words, links and neighbours decide.
    """<div><a href=a>$1</a> <a href=b>$1</a> <a href=c>$2</a></div><h1 data-main>$5</h1><p data-main>$40.</p><p data-main>$35.</p><p data-main>$12.</p><p data-main>$50.</p><div><a href=d>$2</a> <a href=e>$2</a></div><div>$5</div>""",
    """<table><tr><td><a href=a>$1</a><td><a href=b>$1</a><tr><td><a href=c>$1</a></table><div><p data-main>$28.</p><p data-main>$17. <a href=z>$1</a> $20.</p><p data-main>$33.</p></div><div>$3</div><div><a href=d>$4</a></div>""",
    """<ul><li><a href=a>$2</a><li><a href=b>$2</a></ul><div>$2</div><h2 data-main>$7</h2><div data-main>$60.</div><div data-main>$44.</div><div data-main>$26.</div><ul><li><a href=d>$6</a><li><a href=e>$5</a><li><a href=f>$8</a></ul><p>$4</p>""",
    """<div>$1</div><div><a href=b>$1</a></div><h1 data-main>$4</h1><p data-main>$9.</p><p data-main>$24.</p><p data-main>$15.</p><h3>Comments</h3><p>$20.</p><p>$14.</p><p>$35.</p>""",
    """<div><a href=a>$2</a></div><h1 data-main>$6</h1><p data-main>$48.</p><p data-main>$19.</p><h4>Related articles</h4><p>$9.</p><p><a href=x>$8</a></p><div>$3</div>""",
    """<div>$2</div><h1 data-main>$8</h1><p data-main>$12.</p><p data-main>$31.</p><p data-main>$22.</p><div>$4</div>""",
    """<div><a href=a>$1</a></div><h2 data-main>$3</h2><p data-main>$14.</p><p data-main>$42.</p><div><a href=a>$3</a></div>""",
    """<p data-main>$70.</p><p data-main>$30.</p>""",
    """<p data-main>$5.</p><p data-main>$25.</p><p data-main>$11.</p>""",
    """<a href=a>$2</a><hr><a href=b>$1</a><hr><a href=c>$1</a><hr><p>$2</p><form><p>$3</p><p>$9.</p></form><p>$1</p>""",
]

_MARK = re.compile(r"\$(\d+)(\.?)")


def labelled_pages() -> list[str]:
    """The pages, with their filler."""
    place = 0

    def fill(match: re.Match) -> str:
        nonlocal place
        place += 1
        n = int(match[1])
        words = [_FILLER[(place + 5 * i) % len(_FILLER)] for i in range(n)]
        return " ".join(words).capitalize() + match[2]

    return [_MARK.sub(fill, page) for page in _PAGES]
