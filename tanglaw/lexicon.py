"""Word lists, patterns and constants that results depend on.

All values in this module must equal those of the curation rules that this engine reproduces. Patterns are written in the dialect that Java and RE2 share unless a name ends in
``_JAVA`` (lookaround).
"""

from __future__ import annotations

#: White space as Unicode text libraries see it, spelled out since engines differ on ``\s``.
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = "[^" + WS[1:]
#: The characters of ``WS``.
WS_SIGNS = "\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000"

LANGUAGES = ("tagalog", "cebuano", "bikol", "hiligaynon", "minasbate", "karay-a", "rinconada")
HIGH_RESOURCE = ("tagalog", "cebuano", "bikol")
LOW_RESOURCE = ("hiligaynon", "minasbate", "karay-a", "rinconada")
LEVELS = (1, 2, 3)
#: The languages of the ISO codes used by the documents table.
ISO = {"tl": "tagalog", "ceb": "cebuano", "bcl": "bikol", "hil": "hiligaynon", "msb": "minasbate", "krj": "karay-a", "bto": "rinconada"}

# Letters of a word, as the feature extractors tokenize (no ñ, ç, ã).
WORD_LETTERS = "a-záéíóúàèìòùâêîôûäëïöüəǝ"
VOWELS_ALL = "aeiouáéíóúàèìòùâêîôûäëïöü"
VOWELS_ACUTE = "aeiouáéíóú"
VOWELS_SCHWA = "aeiouáéíóúəǝ"

# Emit policy.
DROP_FLAGS = ("too_short", "empty", "english_heavy", "duplicate", "residual_boilerplate")
MIN_WORDS = 4
LEVEL_MIN_WORDS = 8
INTERIOR_NATIVE = 2
ENGLISH_HEAVY = 0.40
RBO_P = 0.98
FOLDS = 5
SEED = 42
DELTA = 0.03

OPENERS = (
    "si sila siya sinda ikaw kamo ang an ako kami kita ini kini kana usa sarong saro aduna adunay dunay may mayo naa igwa sa kan sin nin mga kada karon ngunyan "
    "kaniadto niadto kaidto idtong hain sain bako diri dai wala kay kun kon iyo"
).split()
NATIVE_FUNC = sorted(
    {
        *OPENERS,
        *(
            "ang an si sa mga ng ni na at kag ug kay sang ini ito siya ako kami sinda nag mag kan sin nin dili wala amo man lang ta ba gid da pa ra ya may isa ka kita kini kana "
            "usa asin saka nga og niya nila iyang akong"
        ).split(),
    }
)
ENG_STOP = (
    "the and of to for with from his her their this that was were are is you your she he they them what who when where into about story book inc resources drivers"
).split()
ENG_ONLY = sorted(
    set(
        (
            "the and of with for was were are his her their they them this that hello world lion cow duck otter elephant bird snake blue sky from have story about into would could "
            "should there what when where who"
        ).split()
    )
)
TL_FUNC = (
    "ang ng sa na ay mga si ni sina kay kina ito iyon iyan ako ikaw siya kami tayo kayo sila niya nila nito ka mo ko at kung ngunit pero dahil para nang wala hindi huwag isa isang "
    "nasa kaya rin din lang naman po ba"
).split()
TL_ENGLISH = (
    "the a an and or of to in on at is are was were be been being this that these those it its his her our their your my for with from by as not no but if then you we they he she "
    "him them us please under over into out about above below work works working licensed license commons attribution noncommercial international copy distribute transmit adapt "
    "adaptation translation translations commercial purposes purpose conditions content contents illustration illustrations reproduced reproduce original developed development "
    "project education department region learning resource resources management curriculum division edition rights reserved reserved. agency united states usaid abc advancing basic "
    "philippines partnership implemented together foundation asia released some terms use attribution author illustrator published publisher publishing books book story brought "
    "program supports early reading skills habits develop next generation critical thinkers creative innovators pacific read more like get further information visit donated property "
    "sale first grade level letters curricular theme reviewed central office permission written photocopying mechanical electronic means form any without part material may "
    "transmitted modified version full view copy visit page cover title contents guide all by-nc creativecommons org licenses http https www com html label following create "
    "translate change changes images image mismo halt foundation- contributing translators inc ltd co pvt pratham storyweaver bloom digitized digitised digitization digitisation "
    "bookmobile scanned archive gutenberg"
).split()
LEVEL_NATIVE = (
    "ang ng nang sa na ay mga si ni nina kay kina ako ka ikaw siya niya kanya kami tayo namin naming natin kayo ninyo sila nila ito iyon iyan nito niyan niyon dito diyan doon hindi "
    "wala may mayroon meron kung dahil pero ngunit subalit at o kaya naman lang lamang din rin ba pa para upang nga raw daw po ho isang isa noong nung habang tuwing matapos bago "
    "saka sapagkat kaysa kapag pag bawat kahit maging dapwat ako'y siya'y ako’y siya’y"
).split()
PHIL_FUNC = "ang an si sa mga ng ni na at kag ug kay sang ini ito siya ako kami sinda nag mag kan sin dili wala amo man lang ta ba gid da pa ra ya may isa ka".split()

TRIGGERS = (
    r"(?:gisulat|sinulat|gisuwat|sinuwat|gihuwat|isinulat|ginsurat|gindrowing|gidrowing|gidibu(?:h[io]|uh[io])|gihulagway|ginhulagway|sininurat|gihikay|hinikay|tinipon|gindrawing|"
    r"gihubad|istorya|tigmantala|written\s+by|illustrated\s+by|story\s+by|adapted\s+by|drawn\s+by|translated\s+by)"
)
LANGUAGE_NAMES = r"cebuano|bikol(?:ano)?|tagalog|hiligaynon|minasbate\w*|karay-?a|rinconada"
GENRE_WORDS = (
    r"personal|development|story|book|community|living|animal|stories|traditional|science|math\w*|health|environment|primer|reader|dictionary|agriculture|fiction|non|mother|tongue|"
    r"folk|tale|decodable|grade|level|stage"
)
NAME_STOP = "|".join([*sorted(OPENERS), LANGUAGE_NAMES, GENRE_WORDS])
NAME_SEPARATOR = r"(?:[&,]|\b(?i:and|ug|asin|saka|y)\b)"
# One capitalised name of a credit, and the credit: trigger, ni/nila/by, colon, up to 12 names.
CREDIT_NAME_JAVA = (
    rf"(?:(?:{NAME_SEPARATOR}\s*)?(?i:(?!{TRIGGERS}\b)(?!(?:{NAME_STOP})\b))\p{{Lu}}[\p{{L}}.'\-]*\.?(?=\s+(?:\p{{Lu}}|{NAME_SEPARATOR})|\s*$)\s*)"
)
CREDIT_JAVA = rf"\b(?i:{TRIGGERS})\b(?:\s*(?i:ni(?:la)?|by))*\s*:?\s*{CREDIT_NAME_JAVA}{{0,12}}"
META_WORD = rf"(?i)\b(?:{TRIGGERS}|{LANGUAGE_NAMES}|{GENRE_WORDS})\b"
GENRE_PHRASE = (
    r"(?i)\b(?:story\s*book|animal\s+stories|personal\s+development|community\s+living|traditional\s+story|mother\s+tongue|non[\s-]?fiction|folk\s*tale|\(?decodable\)?)\b"
)
GENRE_TAG = (
    rf"(?i)\b(?:{LANGUAGE_NAMES})\b\s*(?:personal\s+development|story\s*book|community\s+living|animal\s+stories|traditional\s+story|non[\s-]?fiction|mother\s+tongue|science|math\w*|"
    r"health|environment|primer|reader|dictionary|agriculture|folk\s*tale|fiction)?"
)
META_LABEL = r"\b(?i:Pinulongan|Petsa(?:\s+sa\s+\p{L}+)?)\s*:\s*(?:\p{L}+\s*,?\s*)?"
EDITORIAL = r"(?is)\bUbos\s+sa\s+pagtambag\b.*?\bLiwayway\s+Publications[,\s]*Manila\b"
PUBLISHER = (
    r"Story\s+Alt\s+Img|Sync\s+Translation|Translation\s*Publish|Table\s+of\s+Contents|Guide\s+Cover|Comprehension\s+Questions|All\s+Children\s+Reading|Room\s+to\s+Read|"
    r"(?:The\s+)?Asia\s+Foundation|Bilum\s+Books|Creative\s+Commons|\bUSAID\b|Let.?s\s+Read|Brought\s+to\s+you\s+by|This\s+(?:book|product|storybook|story)\s+(?:was|is|received)|"
    r"ABC\+|Pum\s+Anh|For\s+full\s+terms\s+of\s+use|Contributing\s+translators|Enabling\s+Writers|\(Decodable\)|\bCopyright\b|©|Litara\s+Foundation|Third\s+Story|Original\s+Story|"
    r"An\s+(?:produktong|librong|stroybook)\s+ini|\bGrade\s+\d+\b|creative\s+non[\s-]?fiction|Ini\s+nga\s+storybook|nakabaton\s+sang\s+bulig|Ini\s+na\s+libro|"
    r"An\s+libro\s+na\s+ini|Ang?\s+storybook\s+na\s+ini"
)
CANVAS = r"(?i)[^.!?]*\bCANVAS\b[^.!?]*[.!?]\s*(?:(?:Salamat|Mabalos)\s*[.!?]\s*)?"
BIO_TAIL = (
    r"(?i)(?:\b(?:Dapit|Nahanungod|Mahanungod|Mahitungod|Bahin|Parte|Manungod|Mahin?ungod)\s+(?:sa|kan|ni|kang|ki)\s+(?:Kagsurat|Para?surat|Para?kurit|Ilustrador|Manunulat|Awtor|"
    r"Kagdrowing|Paradrowing|Paradibuho|Tagsulat|Tagguhit|Tagdrowing|Proyekto)\b|\btagsulat,\s*ilustrador\b|\bilustrador\s+(?:ug|kag|asin|saka)\s+(?:publisher|editor)\b|\bparakurit\b)"
)
BIO_WORDS = (
    r"(?i)\b(?:kagsurat|para?surat|para?kurit|ilustrador|tagsulat|tagguhit|tagdrowing|awtor|manunulat|proyekto|paradibuho|paradrowing|kagdrowing)\b"
)
BASAHA_TAIL = (
    r"(?im)(?:^\s*(?:Mga\s+Hapot|Kahapotan|Pagkasabot\s+sa\s+mga\s+Hapot|Mga\s+Pagmidbid|Dapit\s+sa\s+[Kk]ag\w+|Ulubrahun|Aktibidad|Gibohon|Activity|Ehersisyo|Mga\s+Eksampol)\b|"
    + PUBLISHER + ")"
)
NUMBERED = r"(?s)\b1\.\s.+?\b2\.\s.+?\b3\.\s"
QA_HEAD = (
    r"(?i)\s*(?:(?:Mga\s+)?Pamangkot\w*|(?:Mga\s+)?Hunga\w*|Palamangkutanon|Pamangkutanon|Comprehension\s+Questions?|(?:Mga\s+)?Giya\s+sa\s+Pagtuon|Pagsabot|Pagtuon)\s*:?\s*$"
)
DIGIT_INTERLEAVE = r"(?:\b\d{1,4}\b[ ]+){3,}"
LEAD_ATTRIBUTION = (
    r"(?i)^(?:All\s+Children\s+Reading|Room\s+to\s+Read|The\s+Asia\s+Foundation|Let.?s\s+Read|Pratham\s+Books|Book\s+Dash|African\s+Storybook|StoryWeaver|Bloom\s+Library|"
    r"Global\s+Digital\s+Library)\b.*$"
)
NAME_BLOCK = r"^(?:\p{Lu}[\p{L}.'\-]*\.?\s+)*\p{Lu}[\p{L}.'\-]*\.?$"
PAGE_MARKER = r"(?im)^\s*(?:Page\s+\d+|Guide|Cover|Copyright|Start\s+of\s+Story|Table\s+of\s+Contents)\s*$"
# Entities in the order in which they are replaced.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&"), (r"&#\d+;", ""), ("&[a-zA-Z]+;", ""))
URL = r"https?://" + NOT_WS + "+"
TITLE_FUNC = "ni|ng|nga|ug|sa|si|an|at|kan|nin|kay|asin|saka|na|kag|sang|sin|ka|y"
TITLE_WORD = rf"(?:\p{{Lu}}[\p{{Ll}}'’\-]*|(?:{TITLE_FUNC}))"
OPENER_WORD = "(?:Si|Ang|An|Adunay|Aduna|Dunay|Igwa|May|Usa|Sarong|Saro|Kang|Ining|Naa|Kini|Kana|Ini|Niadto|Kaniadto)"
TITLE_REPEAT = rf"(?s)^({TITLE_WORD}(?:\s+{TITLE_WORD}){{1,7}})\s+({OPENER_WORD}\s+\p{{L}}.*)$"

TL_TRIGGERS = (
    r"(?:Isinulat|Isinurat|Iginuhit|Idrinowing|Idinrowing|Idinibuho|Sinuri|Inedit|Isinalin|Itinongol|Inilarawan|Gini?nuhit|Sinulat|Ginsulat|Ginlaragway|Ginhulagway|Gin-?edit|"
    r"Ginguhit|Limbitco|Isinatitik|Isulat|Isinalarawan|Isinaayos|Kinulayan|Tagawasto|Inilathala|Kinunan)"
)
TL_CONNECTORS = "(?i:at|saka|asin|kag|nina|nira|nanday|kanday|y)"
TL_CREDIT_JAVA = (
    rf"\b(?i:{TL_TRIGGERS})\b(?:\s*(?i:nina|nira|nila|nanday|kanday|ni|by))*\s*:?\s*(?:(?i:(?!{TL_TRIGGERS}\b)(?!(?:{'|'.join(sorted(OPENERS))}|ay|nang|{LANGUAGE_NAMES}|{GENRE_WORDS})\b))"
    rf"\p{{Lu}}[\p{{L}}.'’\-]*\.?(?=\s*[,;&]|\s+(?:\p{{Lu}}|{TL_CONNECTORS}\b)|\s*$)\s*[,;&]?\s*(?:{TL_CONNECTORS}\s+)?){{0,40}}"
)
TL_STRUCTURE = (
    r"(?i)(?:DONATED\s+PROPERTY|NOT\s+FOR\s+SALE|·|\bGRADE\s*\d+\b|\bGrade\s*:?\s*\d+\b|\bLevel\s+Letters\b[^.]*|\bCurricular\s+Theme\b[^.]*|\bTheme\s*:[^.]*|\bLevel\b\s*$)"
)
TL_LABEL = (
    r"(?i)\b(?:Writer|Author|Illustrator|Illustrated\s+by|Written\s+by|Editor|Contributor|Contributors|Story\s+by|Adapted\s+by|Translated\s+by|Layout|Guhit\s+ni|Kuwento\s+ni|"
    r"Kwento\s+ni|Iginuhit\s+ni|Isinatitik\s+ni|Binigyang\s+[Kk]ulay(?:\s+ni)?|Disenyo\s+at\s+[Kk]ulay(?:\s+ni)?|Kulay\s+ni|Disenyo\s+ni|Reviewer|Lay-?out\s+Artist|"
    r"Language\s+(?:Editor|Reviewer)|Content\s+(?:Editor|Reviewer))\b\s*:?\s*(?:\p{Lu}[\p{L}.'’\-]*\.?[\s,]*){0,6}"
)
TL_INSTITUTION = (
    r"(?i)(?:Department\s+of\s+Education|DepEd\b|LEARNING\s+RESOURCES?\s+MANAGEMENT|LRMDS|LRMS\b|Schools?\s+Division|District\s+Supervisor|Public\s+Schools|Bureau\s+of|"
    r"Bilum\s+Books|SIL\s+(?:International|PNG)|Published\s+by|Republic\s+of\s+the\s+Philippines|Principal\s+I+\b|CESO\b|Schools?\s+Division\s+Superintendent)"
)
TL_BOILERPLATE = (
    r"(?i)(?:All\s+rights?\s+reserved\.?|No\s+part\s+of\s+this\s+(?:material|book|work)\b[^.]*\.?|You\s+(?:are\s+free|may|must)\b[^.]*|Images?\s+by\b[^.]*|"
    r"The\s+Art\s+Of\s+Reading\b[^.]*|Resources?\s+for\s+the\s+Blind\b[^,.]*|DONATED\s+PROPERTY|NOT\s+FOR\s+SALE|First\s+Edition\b[^.]*|SIL\s+International\b[^.]*|Copyright\s+Page|"
    r"Published\s+by\b[^.]*|LEARNING\s+RESOURCES?\s+MANAGEMENT\b[^.]*|Approved\s+by\b[^.]*|Noted\s+by\b[^.]*|Prepared\s+by\b[^.]*|Quality\s+Assured\s+by\b[^.]*|"
    r"Reviewed\s+by\b[^.]*|Leveled\s+Reader\b[^.]*|IPINAG?BI?BILI\b|IPINAGBABAWAL\b[^.]*)"
)
TL_QUESTIONS = (
    r"(?i)\b(?:Tabang\s+sa\s+(?:Pagkatuto|Pag-?aadal)|Gabay\s+sa\s+Pag-?aaral|Mga\s+Tanong|Sagutin|Pamprosesong\s+Tanong|Gawain|Mga\s+Kasanayan|Mga\s+Kompetensi\w*|"
    r"LEARNING\s+COMPETENC\w+|Learning\s+Competenc\w+|Mga\s+Layunin)\b"
)
TL_PUBLISHER = (
    rf"(?i)(?:{PUBLISHER}|Brought\s+to\s+you\s+by|Original\s+Story|Released\s+under|Some\s+rights\s+reserved|First\s+Edition|For\s+full\s+terms|Contributing\s+translators|CC[\s.\-]?BY|"
    r"Inilimbag\s+ng|End\s+of\s+story|This\s+(?:material|(?:e-?)?book|work)\s+was\s+digiti[sz]ed|Maraming\s+salamat\s+sa\s+pakikinig)"
)
TL_CONTAINER_JAVA = r"^\s*[^,\n]{1,60},\s*[1-3]\s*,\s*(?=\p{Lu})"
BIKOL_SIGNAL = r"(?i)\bTabang\s+sa\s+Pag-?aadal\b|\b(?:Uno\s+a|Tauno|Siisay\s+a|Maati\s+a)\b"
PAGE_NUMBER_JAVA = r"(?<!\S)\d{1,3}(?!\S)"

# First-generation tails.
GEN1_ACTIVITY = (
    r"(?im)(?:^Mga\s+Hapot\s+sa\s+Pag.?intindi|^Kahapotan\s+[Kk]an\s+Mga\s+Naukdan|^Pagkasabot\s+sa\s+mga\s+Hapot|^Mga\s+Pagmidbid|^Dapit\s+sa\s+[Kk]agsurat|^Dapit\s+sa\s+[Kk]agkurit|"
    r"^Ulubrahun\b|^Aktibidad\b|^Gibohon\b|^Activity\b|^Ehersisyo\b|^Mga\s+Eksampol\b)"
)
GEN1_BIKOL_ACTIVITY = (
    r"(?i)(?:Mga\s+Hapot\s+sa\s+Pag.?intindi|Kahapotan\s+[Kk]an\s+Mga\s+Naukdan|Pagkasabot\s+sa\s+mga\s+Hapot|Mga\s+Pagmidbid|Dapit\s+sa\s+[Kk]agsurat|Dapit\s+sa\s+[Kk]agkurit|"
    r"(?:^|\n)\s*Aktibidad\s*(?:\n|$)|(?:^|\n)\s*Gibohon\s*(?:\n|$)|(?:^|\n)\s*Activity\s*(?:\n|$))"
)
GEN1_BOILERPLATE = (
    r"(?i)(?:All\s+Children\s+Reading|The\s+Asia\s+Foundation|An?\s+Pum\s+Anh|Bilum\s+Books|Creative\s+Commons|Room\s+to\s+Read|\bUSAID\b|This\s+book\s+was\s+(?:adapted|made|prepared)|"
    r"This\s+storybook\s+received|This\s+product\s+is\s+made\s+possible|An\s+produktong\s+ini\s+(?:ay|naging)|An\s+librong\s+ini\s+na\s+binuo|Brought\s+to\s+(?:you|You)\s+by|"
    r"Let.s\s+Read\s+is\s+an\s+initiative|For\s+full\s+terms\s+of\s+use|Contributing\s+translators|ABC\+.*?Advancing\s+Basic\s+Education|ABC\+\s+is\s+a\s+partnership|"
    r"Pum\s+Anh\s+Lao\s+sarong)"
)
GEN1_LEAD_LINE = r"(?i)^(?:All\s+Children\s+Reading|Room\s+to\s+Read|The\s+Asia\s+Foundation\s*[-–]\s*Let.?s\s+Read)(\s*[-–]\s*\w+)?$"
GEN1_LEAD = r"(?i)^(?:All\s+Children\s+Reading|Room\s+to\s+Read)(\s*[-–]\s*\w+)?\s+"

# The level cleaner's patterns.
LEVEL_CREDIT = (
    r"(?i)\b(?:isinulat|isinurat|isulat|sinulat|sumulat|iginuhit|ginuhit|iguhit|idinrowing|idrinowing|inilarawan|isinalarawan|naglarawan|kinulayan|kinukulay|tagawasto|isinatitik|"
    r"sinuri|inedit|isinalin|pinatnugutan|writer|author|illustrator|illustrated\s+by|written\s+by|story\s+by|stories\s+by|illustrations?\s+by|reviewed\s+by|edited\s+by|adapted\s+by|"
    r"translated\s+by|layout|editor|reviewer|contributor|graphic\s+artist|layout\s+artist|artist)s?\b\s*(?:ni(?:na|ra)?|nila|ng|by)?\s*[:\-]?\s*"
    r"(?:\p{Lu}[\p{L}.'’\-]*\.?(?:\s+|,\s*|\s+(?:at|and|saka|asin|ni|nina|nira)\s+)){0,40}"
)
LEVEL_CREDIT_NOUN = (
    r"(?i)\b(?:kuwento|kwento|salaysay|guhit|may[\s\-]?akda)\s+(?:ni(?:na|ra)?|nila)\b\s*[:\-]?\s*(?:\p{Lu}[\p{L}.'’\-]*\.?(?:\s+|,\s*|\s+(?:at|and|saka|asin)\s+)){0,8}"
)
LEVEL_ORPHAN = r"(?i)\b(?:ni|nina?|nila|kina)\s*:"
CAPS_RUN = r"(?:\b\p{Lu}[\p{Lu}'’.\-]*\b[ ,]*){2,}"
EMPTY_QUOTES = r"[\"“”]\s*[\"“”]"
PAGE_BANNER = r"(?i)\bpage\s*\|?\s*\d*"
PRODUCT_CODE = r"\(?\b\p{Lu}{1,6}\d[\p{L}\d.\-]+\b\)?"
JUNK_GLYPHS = r"[\x{FFFD}•●·\x{AD}\x{200B}\x{200E}\x{200F}]+"
LEVEL_TAIL = (
    r"(?i)\b(?:pamprosesong\s+(?:mga\s+)?tanong|tungkol\s+sa\s+may[\s\-]?akda|about\s+the\s+(?:author|illustrator|writer)|talasalitaan|sanggunian|tabang\s+sa\s+pag[\s\-]?aadal|"
    r"gabay\s+sa\s+pag[\s\-]?aaral|mga\s+gawain\s*:|mga\s+tanong\s*:|sagutin\s+ang\s+mga\s+(?:sumusunod|tanong))"
)
LEVEL_PUBLISHER = (
    rf"(?i)(?:{PUBLISHER}|released\s+under|pratham\s+books?|book\s+dash|story\s?weaver|©|cc[\s\-]?by|inilimbag\s+ng|end\s+of\s+story|contributing\s+translators|city\s+college|"
    r"general\s+education|sa\s+suporta\s+ng|pag\s*rerecord|parasurat\s+bikolnon|\bretrieved\b|viewtopic|\bhttps?\b|sanggunian)"
)
# Front matter that makes a sentence no story.
LEVEL_META = (
    r"(?i)(?:karapatang[\s\-]?ari|atas\s+ng\s+pangulo|seksiyon\s+9|walang\s+karapatang|republika\s+ng\s+pilipinas|kagawaran\s+ng\s+edukasyon|rehiyon\s+[ivx]+|sangay\s+ng|"
    r"ang\s+kagamitan\s+na\s+ito|sanayang[\s\-]?aralin|maaa?ring\s+maireprodyus|maaa?ring\s+(?:batayan|kopyahin)|inilathala\s+ng|inilimbag\s+ng|pinaunlad\s+na|"
    r"curriculum\s+implementation|learning\s+resources?\s+management|lrmds|lrms|pag[\s\-]?aari\s+ng\s+pamahalaan|hindi\s+ipinagbibili|paunang\s+salita|paalala\s+sa\s+mambabasa|"
    r"leveled\s+reader|(?:first|second|third|fourth)\s+edition|ikalawang\s+edisyon|all\s+rights\s+reserved|\bcopyright\b|presidential\s+decree|department\s+of\s+education|deped|"
    r"no\s+part\s+of\s+this|this\s+material|brought\s+to\s+you\s+by|basa\s+pilipinas|u\.?s\.?\s+agency|usaid|asia\s+foundation|schools?\s+division|district\s+supervisor|"
    r"public\s+schools|quality\s+assurance|donated\s+property|not\s+for\s+sale|\bgrade\b|©|\bsil\s+international|art\s+of\s+reading|resources\s+for\s+the\s+blind|"
    r"all\s+children\s+reading|by[\s\-]?sa\b|community\s+living|\bpanimula\b|\binaasahan\b|malaking\s+aklat|para\s+sa\s+mga\s+mag[\s\-]?aaral|ginawa\s+ang\s+aklat|"
    r"ang\s+aklat\s+na\s+ito|ang\s+(?:kuwentong|kwentong|kuentong)\s+ito|story\s?book|released\s+under|pratham\s+books?|book\s+dash|story\s?weaver|creative\s+commons|"
    r"some\s+rights\s+reserved|terms\s+of\s+use|learning\s+area|competenc|\btitle\s*:|\bcode\s*:|elementary\s+school|bachelor\s+of|digital\s+edition|lesson\s+exemplar|activity\s+sheet)"
)
