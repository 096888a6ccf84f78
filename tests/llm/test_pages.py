"""Pages built otherwise than those that the trees learn from and those of the tables: layouts as sites have them."""

import random

import pytest

from terraweave.llm import extraction

NOUNS = "harbour garden letter engine winter teacher market bridge forest river village window doctor painter ship road summer council library station".split()
VERBS = "crossed painted opened followed measured carried described answered repaired visited closed remembered planned reached counted".split()
ENDS = "before noon,in the old town,without a word,after the storm,for the third time,near the northern gate,by hand,at last,under a grey sky".split(",")


class Site:
    def __init__(self, seed):
        self.r, self.want = random.Random(seed), []

    def sentence(self):
        r = self.r
        return f"The {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} {r.choice(ENDS)}{r.choice(['', ', and the ' + r.choice(NOUNS) + ' ' + r.choice(VERBS) + ' it'])}."

    def prose(self, low=2, high=6):
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def title(self):
        return f"How the {self.r.choice(NOUNS)} {self.r.choice(VERBS)} a {self.r.choice(NOUNS)}"

    def keep(self, tag, text, attributes=""):
        self.want.append(text)
        return f"<{tag}{attributes}>{text}</{tag}>"

    def paragraphs(self, low, high, size=(2, 6)):
        return "\n".join(self.keep("p", self.prose(*size)) for _ in range(self.r.randint(low, high)))

    def menu(self):
        return "".join(f'<li><a href="/{n}">{n.title()}</a></li>' for n in self.r.sample(NOUNS, self.r.randint(3, 7)))

    # Layouts: each gives a page and fills want.
    def unnamed(self):
        return f"<html><body><ul>{self.menu()}</ul><div>{self.keep('h2', self.title())}{self.paragraphs(3, 3, (4, 8))}</div></body></html>"

    def unnamed_short(self):
        return f"<html><body><ul>{self.menu()}</ul><div>{self.keep('h2', self.title())}{self.paragraphs(2, 2, (1, 2))}</div></body></html>"

    def in_main(self):
        return f"<!doctype html><html><body><nav>{self.menu()}</nav><main>{self.keep('h1', self.title())}{self.paragraphs(2, 4)}{self.keep('blockquote', self.prose(1, 2))}<figure><img src=x>{self.keep('figcaption', self.sentence())}</figure>{self.paragraphs(1, 2)}</main><footer><p>Copyright 2020 The Daily {self.r.choice(NOUNS).title()}. All rights reserved.</p></footer></body></html>"

    def two_paragraphs(self):
        return self.paragraphs(2, 2)

    def body_text(self):
        first = self.prose()
        self.want.append(first)
        return f"<html><body>{first}{self.keep('p', self.prose())}</body></html>"

    def text_then_p(self):
        first = self.prose()
        self.want.append(first)
        return f"{first}{self.keep('p', self.prose())}"

    def broken_lines(self):
        self.want.append("Line one Line two")
        return "Line one<br>Line two"

    def less_than(self):
        text = f"{self.sentence()} As 3 < 4 and 5 > 2, {self.sentence()}"
        self.want.append(text)
        return text

    def div_breaks(self):
        lines = [self.sentence() for _ in range(4)]
        self.want.append(" ".join(lines))
        return f"<html><body><div>{'<br>'.join(lines)}</div></body></html>"

    def manual(self):
        body = self.keep("h1", self.title()) + self.paragraphs(1, 2)
        body += "<dl>" + "".join(self.keep("dt", self.r.choice(NOUNS)) + self.keep("dd", self.sentence()) for _ in range(3)) + "</dl>"
        body += "<table>" + "".join("<tr>" + self.keep("td", self.r.choice(NOUNS)) + self.keep("td", self.r.choice(ENDS)) + "</tr>" for _ in range(3)) + "</table>"
        body += "<ul>" + "".join(self.keep("li", self.sentence()) for _ in range(3)) + "</ul>" + self.keep("pre", "run --all harbour")
        return f"<html><body><header><a href=/>Manual</a></header><article>{body}</article></body></html>"

    def blog(self):
        side = f"<div class='col-4 sidebar'><h4>Archive</h4><ul>{self.menu()}</ul></div>"
        return f"<html><head><title>t</title></head><body><div class='navbar'><ul>{self.menu()}</ul></div><div class='row'><div class='col-8'>{self.keep('h1', self.title())}{self.paragraphs(3, 8)}</div>{side}</div><div id='footer'>Powered by a small engine. <a href='/imprint'>Imprint</a></div></body></html>"

    def news(self):
        comments = "".join(f"<div class='comment'><p>{self.sentence()}</p></div>" for _ in range(self.r.randint(1, 5)))
        return f"<html><body><div id='cookie-banner'><p>We use cookies to improve this site.</p><button>Accept</button></div><nav><ul>{self.menu()}</ul></nav><div id='x17'><section>{self.keep('h1', self.title())}<div class='ad-slot'>Buy a {self.r.choice(NOUNS)} today</div>{self.paragraphs(3, 6)}</section></div><section id='comments'><h3>Comments</h3>{comments}</section><footer>All rights reserved</footer></body></html>"

    def nested(self):
        head = self.keep("h1", self.title())
        parts = "".join(f"<section>{self.keep('h2', self.title())}{self.paragraphs(1, 3)}</section>" for _ in range(3))
        return f"<html><body><div><div><div>{head}{parts}</div></div></div><div class='newsletter'><form><label>Mail</label><input><button>Subscribe</button></form></div></body></html>"


LAYOUTS = [k for k, v in vars(Site).items() if callable(v) and k not in ("__init__", "sentence", "prose", "title", "keep", "paragraphs", "menu")]


@pytest.fixture(scope="module")
def found(spark):
    sites = {(k, n): Site(f"{k}-{n}") for k in LAYOUTS for n in range(40)}
    rows = [(i, "u", getattr(site, k)()) for i, ((k, _), site) in enumerate(sites.items())]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return {key: (got[i], "\n".join(site.want), rows[i][2]) for i, (key, site) in enumerate(sites.items())}


def test_most_pages_come_out_exactly(found):
    exact = {k: sum(found[k, n][0] == found[k, n][1] for n in range(40)) for k in LAYOUTS}
    assert sum(exact.values()) >= 0.95 * 40 * len(LAYOUTS), exact
    assert min(exact.values()) >= 24, exact


def test_no_article_is_lost_and_little_is_added(found):
    for got, want, page in found.values():
        kept = sum(len(line) for line in want.split("\n") if line in got)
        assert kept >= 0.5 * len(want.replace("\n", "")), page
        assert len(got) <= 1.5 * len(want) + 60, page
