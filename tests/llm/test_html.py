"""Pages in languages without a list of stop words, of short lines, and with preformatted text, none of which marks its article."""

import pytest
from assay.llm import html_text

MENU = "<header><a href=h>Home</a></header><nav><a href=x>Home</a> <a href=y>News</a></nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul>"
FOOT = "<ul><li><a href=3>About</a></ul><footer>© 2024</footer>"
STORIES = {
    "it": ["La storia della città", "La storia della città comincia molti secoli fa, quando i primi abitanti costruirono le case vicino al fiume e iniziarono a coltivare i campi.", "Oggi conserva ancora molte tracce di quel tempo lontano, e ogni anno arrivano visitatori da tutto il mondo per vedere le sue antiche piazze."],
    "pt": ["A história da cidade", "A história da cidade começa há muitos séculos, quando os primeiros habitantes construíram casas perto do rio e começaram a cultivar os campos.", "Hoje a cidade ainda conserva muitos vestígios daquele tempo distante, e todos os anos chegam visitantes do mundo inteiro para ver as praças."],
    "ru": ["История города", "История города начинается много веков назад, когда первые жители построили дома у реки и начали возделывать поля вокруг холмов.", "Сегодня город всё ещё хранит следы того далёкого времени, и каждый год сюда приезжают гости со всего мира."],
    "zh": ["城市的历史", "这座城市的历史始于许多世纪以前，当时第一批居民在河边建造房屋并开始耕种田地，后来又修建了城墙。", "今天这座城市仍然保留着那个遥远时代的许多痕迹。"],
    "ja": ["町の歴史", "この町の歴史は何世紀も前に始まり、最初の住民が川のそばに家を建て、畑を耕し始めた。その後、城壁も築かれた。", "今もその時代の跡が多く残っていて、毎年世界中から人々が訪れる。"],
    "poem": [f"A line of it, number {i}" for i in range(12)],
}


@pytest.mark.parametrize("name", sorted(STORIES))
@pytest.mark.parametrize("wrap", ["{}", "<div class='has-sidebar'>{}</div>", "<div><article>{}</article></div>"])
def test_whole_stories(name, wrap):
    head, *rest = STORIES[name]
    page = f"<body>{MENU}{wrap.format(f'<h1>{head}</h1>' + ''.join(f'<p>{x}</p>' for x in rest))}{FOOT}</body>"
    assert html_text.main_text(page) == "\n\n".join(STORIES[name])


def test_preformatted_text_stays_between_paragraphs():
    text = "It is the story of a town that was built by the river in the time of the kings, and of the people that lived in it for years and years, with the sea to the south."
    code = "for (int i = 0; i < 10; i++) { total += values[i] * weights[i]; if (total > limit) break; }  printf(\"%d\", total); return total;"
    page = f"<body>{MENU}<p>{text}</p><pre>{code.replace('<', '&lt;')}</pre><p>{text}</p>{FOOT}"
    assert html_text.main_text(page) == "\n\n".join([text, " ".join(code.split()), text])


def test_words_still_tell_where_the_language_is_listed():
    text = "It is the story of a town that was built by the river in the time of the kings, and of the people that lived in it for years and years, with the sea to the south."
    junk = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Sigma Tau Upsilon Phi Chi Psi Omega Aleph Beth Gimel Daleth"
    assert html_text.main_text(f"<body>{MENU}<p>{text}</p><p>{text}</p><div>{junk}</div>{FOOT}") == f"{text}\n\n{text}"
    assert html_text.listed([]) and html_text.listed([html_text.Block(text, 0, False)]) and not html_text.listed([html_text.Block(junk, 0, False)])
