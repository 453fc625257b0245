"""Pages whose text is short, broken by unwanted elements, or beside a small article."""

from cellweave.llm.html_text import main_text


def test_short_text_is_kept():
    assert main_text("<body><p>Short text.</p></body>") == "Short text."
    gaps = "<nav>x</nav><aside>y</aside><form>z</form>"
    assert main_text(f"<body><p>{'A long paragraph. ' * 9}</p>{gaps}<p>The end.</p></body>").endswith("\nThe end.")


def test_text_beside_a_teaser_is_kept():
    story = "A long paragraph of the story. " * 20
    assert main_text(f"<article><p>Teaser</p></article><div><p>{story}</p></div>") == f"Teaser\n{story.strip()}"
    assert main_text(f"<article><p>{story}</p></article><div><p>More from us</p></div>") == story.strip()
