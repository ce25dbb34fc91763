"""Hand-written layouts with the text that a reader would call the article."""

import pytest

from quillmill.llm.html_extract import main_text

A = "The river, wide and slow, carried the boats past the mill, the church, and the old market square."
B = "Nobody in the village remembered who had built the bridge, or why it had been left unfinished."
C = "When spring came, the water rose, and the carpenters, who had waited all winter, set to work."
NAV = "<nav><a href=/>Home</a> <a href=/n>News</a></nav>"
END = "<footer><p>All rights, of course, reserved.</p></footer>"


def art(inner):
    return f"<html><body>{NAV}<article>{inner}</article>{END}</body></html>"


def div(inner):
    return f"<html><body>{NAV}<div id=wrap>{inner}</div>{END}</body></html>"


LAYOUTS = {
    "sources list under a heading": (art(f"<h1>T</h1><p>{A}</p><h2>Sources</h2><ul><li><a href=a>First</a></li><li><a href=b>Second</a></li></ul>"), ["T", A, "Sources", "First", "Second"]),
    "paragraph of class related": (art(f"<p>{A}</p><p class='related'>A related point, made by the mayor, was heard.</p><p>{B}</p>"), [A, "A related point, made by the mayor, was heard.", B]),
    "section on social history": (art(f"<p>{A}</p><section class='social history'><p>{B}</p></section>"), [A, B]),
    "div of legal matters": (art(f"<p>{A}</p><div class='legal'><p>{B}</p></div>"), [A, B]),
    "div on the rail network": (art(f"<div id='rail-network'><p>{B}</p></div><p>{A}</p>"), [B, A]),
    "discussion of results": (art(f"<p>{A}</p><section class='discussion'><h2>Discussion</h2><p>{B}</p></section><p>{C}</p>"), [A, "Discussion", B, C]),
    "feedback loops": (art(f"<section id='feedback-loops'><h2>Loops</h2><p>{B}</p></section><p>{A}</p><p>{C}</p>"), ["Loops", B, A, C]),
    "part two beside the container": (div(f"<div><p>{A}</p><p>{B}</p></div><div><h2>Part two</h2><p>It ended well.</p></div>"), [A, B, "Part two", "It ended well."]),
    "related links box": (art(f"<p>{A}</p><div class='related'><a href=a>One story</a> <a href=b>Other story</a></div><p>{B}</p>"), [A, B]),
    "related list under its title": (art(f"<p>{A}</p><p>{B}</p><h3>Related articles</h3><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"), [A, B, "Related articles"]),
    "list announced by a sentence": (art(f"<p>{A}</p><p>See these two:</p><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"), [A, "See these two:", "One", "Two"]),
    "share bar": (art(f"<p>{A}</p><div class='share'><a href=x>Share</a> <a href=y>Post</a></div><p>{B}</p>"), [A, B]),
    "social buttons": (art(f"<p>{A}</p><div class='social'><a href=x>F</a> <a href=y>T</a></div><p>{B}</p>"), [A, B]),
    "reply form": (art(f"<p>{A}</p><p>{B}</p><div id='respond'><p>Leave a reply, if you like, below.</p><form><textarea></textarea></form></div>"), [A, B]),
    "notice at the top": (art(f"<div class='notice'><p>This page, as you see, has moved.</p></div><p>{A}</p><p>{B}</p>"), [A, B]),
    "advert in the middle": (art(f"<p>{A}</p><div class='ad'><p>Buy, buy, buy, and save a lot today.</p></div><p>{B}</p>"), [A, B]),
    "paragraph that is an advert": (art(f"<p>{A}</p><p class='ad'>Buy now.</p><p>{B}</p>"), [A, B]),
    "comments below": (art(f"<p>{A}</p><p>{B}</p>") .replace("</article>", f"</article><div id='comments'><p>{C}</p></div>"), [A, B]),
    "comments inside": (art(f"<p>{A}</p><p>{B}</p><section class='comments'><p>{C}</p></section>"), [A, B]),
    "header of the article": (art(f"<header><h1>Title</h1><p>By someone.</p></header><p>{A}</p>"), ["Title", "By someone.", A]),
    "aside in the article": (art(f"<p>{A}</p><aside><p>{C}</p></aside><p>{B}</p>"), [A, B]),
    "figure and caption": (art(f"<p>{A}</p><figure><img src=x><figcaption>The mill.</figcaption></figure><p>{B}</p>"), [A, "The mill.", B]),
    "quote": (art(f"<p>{A}</p><blockquote>{B}</blockquote>"), [A, B]),
    "numbered list": (art(f"<p>{A}</p><ol><li>One.</li><li>Two.</li></ol>"), [A, "One.", "Two."]),
    "table of data": (art(f"<p>{A}</p><table><tr><td>1</td><td>2</td></tr></table>"), [A, "1", "2"]),
    "preformatted text": (art(f"<p>{A}</p><pre>x  =\n 1</pre>"), [A, "x = 1"]),
    "line breaks": (art(f"<p>{A}<br>{B}</p>"), [f"{A} {B}"]),
    "references": (art("<p>Caf&eacute; &#8212; &lt;b&gt; &amp;amp;</p>"), ["Café — <b> &amp;"]),
    "hidden text": (art(f"<p>{A}</p><p hidden>{B}</p><div style='display: none'>{C}</div>"), [A]),
    "search role": (art(f"<p>{A}</p><div role=search>Find, seek, and look up</div>"), [A]),
    "sidebar beside divs": (div(f"<div class='sidebar'><p>{C}</p></div><div class='content'><p>{A}</p><p>{B}</p></div>"), [A, B]),
    "cookie banner": (div(f"<div class='cookie-banner'><p>We use cookies, and more of them, for you.</p></div><div><p>{A}</p><p>{B}</p></div>"), [A, B]),
    "popular box with a title": (div(f"<div><p>{A}</p><p>{B}</p></div><div><h3>Popular</h3><p>Ten places to see.</p></div>"), [A, B]),
    "main element": (f"<body>{NAV}<main><h1>T</h1><p>{A}</p></main>{END}</body>", ["T", A]),
    "short words in a main": (f"<body>{NAV}<main><p>Yes.</p></main>{END}</body>", ["Yes."]),
    "unclosed paragraphs": (art(f"<p>{A}<p>{B}<p>{C}"), [A, B, C]),
    "sections of a div page": (div(f"<section><h2>One</h2><p>{A}</p><p>{C}</p></section><section><h2>Two</h2><p>{B}</p></section>"), ["One", A, C, "Two", B]),
    "inline names": (art(f"<p>{A} <span class='comment'>Noted.</span></p>"), [f"{A} Noted."]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    html, want = LAYOUTS[name]
    assert main_text(html).split("\n\n") == want
