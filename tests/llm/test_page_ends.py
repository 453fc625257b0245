"""Where unwanted elements of a page end, and what they leave."""

import pytest

from cellweave.llm.html_text import main_text

LONG = "A sentence of the page that is long enough to be its text."


@pytest.mark.parametrize("page, want", [
    ('<article><p class="ad">buy<p>Real one<p>Real two</article>', "Real one\nReal two"),
    (f'<ul><li class="social">x<li>{LONG}</ul><p>{LONG}', f"{LONG}\n{LONG}"),
    (f'<article><ul><li class="social">x<ul><li>inner</ul><li>{LONG}</ul></article>', LONG),
    (f'<article><table><tr><td class="ad">x<td>{LONG}<tr class="ad"><td>y<tr><td>Last</table></article>', f"{LONG}\nLast"),
    (f'<article><dl><dt class="share">x<dd>{LONG}</dl></article>', LONG),
    (f'<article><div><p class="promo">x</div><div>{LONG}</div></article>', LONG),
    (f'<article><ul><li><p class="ad">x</li><li>{LONG}</li></ul></article>', LONG),
    ("<article><p>Hello <script>x</script>world</p></article>", "Hello world"),
    ('<article><p>See <span class="share-count">3</span> the rest</p></article>', "See the rest"),
    (f"<header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n{LONG}"),
    (f'<article><p hidden>no</p><p style="color:red; display: none">no</p><p>{LONG}</p><p data-x="hidden">Yes</p></article>', f"{LONG}\nYes"),
    (f"<form><p>{LONG}</p><select><option>a<option>b</select><p>{LONG}</p></form>", f"{LONG}\n{LONG}"),
    (f"<p>{LONG}</p><form><label>Name</label><input></form>", LONG),
    ('<article><div class="ad"><div>x</div>y</div><p>After</p></article>', "After"),
])
def test_ends(page, want):
    assert main_text(page) == want
