"""Each site's spec on own markup, and paging until the site's own stop."""

import sys

import pytest
from pyspark import cloudpickle

from ledgerlark.sources import fetching, registry, sites

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not import tests

TODAY = "2026-09-01"


def rows(spark, site, html, venue="The Hall"):
    got = sites.events(spark.createDataFrame([(html,)], "html string"), site, venue, TODAY).orderBy("date", "title").collect()
    return [r.asDict() for r in got]


def pick(got, *cols):
    return [tuple(r[c] for c in cols) for r in got]


def test_cigale(spark):
    card = '<li class="artiste-event__item" data-type="{}" data-genre="{}" data-date="{}"><a href="https://x/{}" class="artiste-event__link"></a><img alt="{}" class="artiste-event__img" src="i.png"><h3 class="artiste-event__title b">{}</h3><b class="arimo-semibold-14">19:30</b></li>'
    page = card.format("Concert", "Chanson", "20261003", "a", "A à La Boule Noire", "Ana") + card.format("Spectacle", "Humour", "20261004", "b", "", "Bob") + card.format("Autre", "Pop Rock", "20261005", "c", "", "Cam") + card.format("Concert", "", "20261006", "d", "", "Dee")
    got = rows(spark, "cigale", page)
    assert pick(got, "title", "is_music", "raw_genre", "venue", "venue_slug", "image") == [("Ana", True, "Chanson", "La Boule Noire", "la-boule-noire", "i.png"), ("Bob", False, "Humour", "The Hall", "the-hall", "i.png"), ("Cam", True, "Pop Rock", "The Hall", "the-hall", "i.png"), ("Dee", True, "Concert", "The Hall", "the-hall", "i.png")]


def test_bataclan(spark):
    head = '<article class="o-event x"><div class="text-xs uppercase a">{}</div><h3><span class="t">{}</span>{}</h3><div class="font-title uppercase z text-lg">{}</div>{}</article>'
    page = head.format("Concert", "Ana", "<ul><li> + Bob </li><li>Cam</li></ul>", "sam. 3 octobre 2026", "<b>SOLD OUT</b>") + head.format("Humour", "Dee", "", "4 octobre 2026", '<a href="https://billetterie.bataclan.fr/9">x</a> complet')
    assert pick(rows(spark, "bataclan", page), "title", "sold_out", "is_music", "ticket_url") == [("Ana + Bob + Cam", True, True, None), ("Dee", False, False, "https://billetterie.bataclan.fr/9")]


def test_trianon(spark):
    page = '<div class="bloc_extrait evenement"><a href="u1" title="From Link" class="link"></a><div class="date">3 octobre 2026</div></div><div class="bloc_extrait evenement"><a href="u2" class="link"></a><div class="titre">Own</div><div class="date">4 octobre 2026</div><i>COMPLET</i></div><div class="bloc_extrait evenement"><a href="u2" class="link"></a><div class="titre">Again</div><div class="date">4 octobre 2026</div></div>'
    assert pick(rows(spark, "trianon", page), "title", "sold_out") == [("From Link", False), ("Own", True)]


def test_petitbain(spark):
    block = '<div class="unevt {}"><a href="u"></a><div id="ladatevtmin">{}</div>{}<i class="categorie-club"></i></div>'
    page = block.format("categorie-agenda categorie-concerts categorie-gratuit", "3 octobre", '<div id="nomsoiree">Ana</div>') + block.format("categorie-expo billetterie-annule", "4 octobre", '<span class="titartprog">Bob</span>') + block.format("", "5 octobre", '<div id="nomsoiree">Cam</div>')
    assert pick(rows(spark, "petitbain", page), "title", "raw_genre", "free", "cancelled", "is_music") == [("Ana", "concerts, gratuit", True, False, True), ("Bob", "expo", False, True, False), ("Cam", None, False, False, True)]


def test_pointephemere(spark):
    page = '<a href="/event/a"><span class="b truncate">Ana</span><div class="w-[10%] x">SAM</div><div class="w-[20%]">03.10 20h30</div><div class="relative truncate">Jazz</div></a>'
    assert pick(rows(spark, "pointephemere", page), "title", "date", "time", "raw_genre", "url") == [("Ana", "2026-10-03", "20:30", "Jazz", "https://www.pointephemere.org/event/a")]


def test_cafedeladanse(spark):
    block = '<div class="gt-title"><a href="u">Ana</a></div><div class="gt-date"><b></b><span>3 octobre 2026</span></div><div class="gt-time"><span>20:00</span></div><div class="gt-location"><ul><li><a>Folk</a></li></ul></div><div class="gt-price">{}</div>'
    assert pick(rows(spark, "cafedeladanse", block.format("Entrée libre") + block.format("30 €")), "title", "time", "raw_genre", "price", "free") == [("Ana", "20:00", "Folk", "Entrée libre", True)]


def test_hasardludique(spark):
    card = '<a class="event_card {}" href="/e/1"><div> <span>#pop #indie </span></div><h3>{}</h3><strong>3 octobre 2026</strong><i style="background-image: url(\'i.png\')"></i></a>'
    assert pick(rows(spark, "hasardludique", card.format("concert", "Ana") + card.format("atelier", "Bob")), "title", "raw_genre", "is_music", "url", "image") == [("Ana", "pop, indie", True, "https://www.lehasardludique.paris/e/1", "i.png"), ("Bob", "pop, indie", False, "https://www.lehasardludique.paris/e/1", "i.png")]


def test_instantschavires(spark):
    page = '<article id="post-1"><span class="dates_evenements"><a href="u">03.10.2026</a></span><h2 class="entry-title"><a href="u">Ana<br/>(solo)<br />Bob<br>+ Cam</a></h2></article>'
    assert pick(rows(spark, "instantschavires", page), "title", "date") == [("Ana (solo) + Bob + Cam", "2026-10-03")]


def test_newmorning(spark):
    page = '{"@type":"Event", "name":"Ana "the" Great",\n"startDate":"2026-10-03T20:00","url":"u","offers":{"price": "25"},\n"description":"A <b>night</b>",\n"image":"i.png"}, {"@type":"Event","name":"Bob","startDate":"2026-10-04"}'
    assert pick(rows(spark, "newmorning", page), "title", "date", "price", "description", "image") == [('Ana "the" Great', "2026-10-03", "25 €", "A night", "i.png"), ("Bob", "2026-10-04", None, None, None)]


def test_dernierbar(spark):
    page = "<p>Bonjour</p><p>* VENDREDI 4 SEPTEMBRE — 20H00</p><p>LE QUIZ DU SOIR</p><p>🎮 Avec de la musique</p><p>SAMEDI 12 SEPTEMBRE — GRAND CONCERT !</p><p>Trois groupes</p><p>Dimanche 20 septembre – à partir de 17h</p><p>La jam</p><p>Samedi 26 septembre</p><p>Samedi 12 septembre — GRAND CONCERT !</p><p>x</p><p>MARDI 5 SEPTEMBRE — LE JOUR FAUX</p>"
    assert pick(rows(spark, "dernierbar", page), "date", "time", "title", "description", "is_music") == [("2026-09-04", "20:00", "Le Quiz Du Soir", "Avec de la musique", False), ("2026-09-12", None, "Grand Concert", "Trois groupes", True), ("2026-09-20", "17:00", "La jam", None, True), ("2026-09-26", None, "x", None, False)]


class Web:
    """Pages by address; every request is a line in a file, for the executors are other processes."""

    def __init__(self, log, pages):
        self.log, self.pages = str(log), pages

    def __call__(self, url):
        with open(self.log, "a") as f:
            f.write(url + "\n")
        if url not in self.pages:
            raise fetching.Refused(404)
        return self.pages[url]

    def asked(self):
        with open(self.log) as f:
            return f.read().split()


def scraped(spark, web, site, url):
    venue = {"slug": "own", "name": "The Hall", "strategy": site, "url": url}
    got = registry.run(spark, [venue], {"today": TODAY, "horizon_days": 730, "fetch": web})
    return got, got.events and [r.asDict() for r in got.events.orderBy("date", "title").collect()]


def test_boulenoire_pages_until_they_repeat(spark, tmp_path):
    card = '<article class="elementor-post {}"><h2 class="elementor-post__title"> <a href="u{}">{}</a></h2><div class="elementor-post__excerpt">{}</div></article>'
    one = card.format("", 1, "Ana", "SAMEDI 3 OCTOBRE 2026 – 19H30") + card.format("category-complet", 2, "Bob", "15, 16 &amp; 17 OCTOBRE 2026")
    two = card.format("", 3, "Cam", "1er novembre")
    web = Web(tmp_path / "log", {"https://h/p": one, "https://h/p/page/2/": two, "https://h/p/page/3/": two, "https://h/p/page/4/": two})
    run, got = scraped(spark, web, "boulenoire", "https://h/p")
    assert pick(got, "title", "date", "time", "sold_out", "venue_slug") == [("Ana", "2026-10-03", "19:30", False, "own")] + [("Bob", f"2026-10-{d}", None, True, "own") for d in (15, 16, 17)] + [("Cam", "2026-11-01", None, False, "own")]
    assert web.asked() == ["https://h/p", "https://h/p/page/2/", "https://h/p/page/3/"] and run.report[0]["count"] == 5


def test_maroquinerie_pages_while_full(spark, tmp_path):
    card = '<li class="event"><a href="/e/{0}"><h2>Show {0}</h2><h3 class="date">3 octobre 2026</h3></li>'
    at = "https://www.lamaroquinerie.fr/fr/agenda/results/?of={}"
    web = Web(tmp_path / "log", {at.format(0): "".join(card.format(i) for i in range(50)), at.format(50): "".join(card.format(i) for i in range(48, 60)), at.format(100): card.format(99)})
    run, got = scraped(spark, web, "maroquinerie", "https://x")
    assert len(got) == 60 and web.asked() == [at.format(0), at.format(50)]


def event_page(offers, free="false", text=""):
    return f'<script type="application/ld+json">{{bad</script><script type="application/ld+json">{{"@type":"Event","isAccessibleForFree":{free},"offers":{offers}}}</script><div class="field field--name-field-texte">{text}</div>'


def test_balchavaux(spark, tmp_path):
    card = '<div class="views-row"><a href="/agenda/{}"></a><noscript> <img src="/i.png"></noscript><div class="a evt-date b" data-day="{}" data-month="Octobre" data-year="2026"><span class="evt-date-hour">• 19:30 > 23:00</span></div>{}{}<h2> {} </h2>{}</div>'
    cat = '<span data-term-name="x">{}</span>'
    one = card.format("a", "01", cat.format("Jazz") + cat.format("Danse"), "", "ANA", "") + card.format("b", "02", cat.format("Atelier"), "<h2>X présente</h2>", "BOB", "<div>with Y</div>") + card.format("c", "03", "", '<b data-status-key="canceled"></b>', "CAM", "") + card.format("old", "01", "", "", "OLD", "").replace("Octobre", "Août") + '<a class="b" href="?page=1" rel="next">more</a>'
    two = card.format("a", "01", "", "", "ANA", "") + card.format("d", "04", "", '<b data-status-key="full"></b>', "DEE", "")
    base = "https://bal/agenda"
    pages = {
        base: one, base + "?page=1": two,
        base + "/a": event_page('[{"name":"Pre","price":32,"availability":"InStock"},{"name":"Door","price":"35.5","availability":"SoldOut"}]', text='<p>Tickets <a href="https://dice.fm/event/z">z</a></p><p>A legend of the double bass.</p>'),
        base + "/b": event_page('{"name":"Ex","price":0}', text="<p>Entrée libre, 10€ conseillé</p><p>A workshop to let go.</p>"),
        base + "/c": event_page('[{"name":"P","price":20}]'),
        base + "/d": event_page('[{"name":"P","price":20,"availability":"x/SoldOut"}]', "true"),
    }
    web = Web(tmp_path / "log", pages)
    run, got = scraped(spark, web, "balchavaux", base)
    assert pick(got, "title", "date", "raw_genre", "is_music", "sold_out", "cancelled", "price", "free", "ticket_url", "description") == [
        ("OLD", "2026-08-01", None, True, False, False, None, False, None, None),
        ("ANA", "2026-10-01", "Jazz", True, False, False, "32–35.50 €", False, "https://dice.fm/event/z", "A legend of the double bass."),
        ("BOB", "2026-10-02", "Atelier", False, False, False, "Entrée libre, 10€ conseillé", True, base + "/b", "X présente — with Y — A workshop to let go."),
        ("CAM", "2026-10-03", None, True, False, True, "20 €", False, None, None),
        ("DEE", "2026-10-04", None, True, True, False, "20 €", True, base + "/d", None),
    ]
    assert got[1]["url"] == base + "/a" and got[1]["image"] == "https://bal/i.png" and got[1]["time"] == "19:30"
    assert sorted(web.asked()) == sorted([base, base + "?page=1", *[f"{base}/{k}" for k in "abcd"]])  # each page once
    down = Web(tmp_path / "log2", {base: one.replace("?page=1", "")})
    run, got = scraped(spark, down, "balchavaux", base)
    assert len(got) == 4 and {r["price"] for r in got} == {None}


def test_first_page_down(spark, tmp_path):
    run, got = scraped(spark, Web(tmp_path / "log", {}), "trianon", "https://down")
    assert got is None and run.report == [{"slug": "own", "ok": False, "count": 0, "error": "HTTP 404"}]


@pytest.mark.parametrize("site", [*sites.SITES, "dernierbar"])
def test_nothing(spark, site):
    assert sites.events(spark.createDataFrame([("",), (None,), ("<p>no events</p>",)], "html string"), site, "V", TODAY).count() == 0
