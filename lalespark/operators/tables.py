"""Fixed word tables of the analyzer."""

from __future__ import annotations

# Irregular pronouns, by root.
PRONOUNS = {
    "ben": "bana beni bende bendeki",
    "o": "onu ona onda ondan onun onunla onlar onları onlara onlarda onlardan onların onlarla",
    "bu": "bunu buna bunda bundan bunun bununla bunla bunlar bunları bunlara bunlarda bunlardan bunların",
    "şu": "şunu şuna şunda şundan şunun şunlar şunları",
    "biz": "bize",
    "siz": "size sizce sizden",
    "bura": "burada buradan buraya buradaki",
    "ora": "orada oradan oraya oradaki",
    "kendi": "kendimi kendini kendisi kendimize kendinize kendilerine kendinden kendisine kendisini kendisiyle kendinizi kendimce",
    "hep": "hepsi hepimiz hepsini",
    "birbiri": "birbirine birbirini birbirimize birbirlerinden",
    "herkes": "herkesin herkese herkesi",
    "biri": "birisi birileri",
}

# Clitics of the copula and the like, by lemma.
AUXILIARIES = {
    "i": "dir dır tir tır lardır ise sa se ydı ydü ydik ydim idi mış mışsın ken yim dik",
    "y": "di dı du dü ti tı tu tü dum dım dim düm tum tım tim tüm dun dın din dün tun tın tin tün duk dık tuk tık sin diniz dur tur dür tür ydi ydu ydum miş muş ymış iken",
    "mi": "mı mi mu mü mısın misin musun misiniz musunuz mıydı",
    "değil": "değil değildir değildi değildik değilim değiliz değilmiş değilse değilsin değilsiniz değilken",
}

# Ordinal numbers.
ORDINALS = {
    "bir": "birinci", "iki": "ikinci", "üç": "üçüncü", "dört": "dördüncü", "beş": "beşinci", "altı": "altıncı", "yedi": "yedinci",
    "sekiz": "sekizinci", "dokuz": "dokuzuncu", "on": "onuncu", "yirmi": "yirminci", "otuz": "otuzuncu", "kırk": "kırkıncı",
    "elli": "ellinci", "altmış": "altmışıncı", "yetmiş": "yetmişinci", "seksen": "sekseninci", "doksan": "doksanıncı",
    "yüz": "yüzüncü", "bin": "bininci", "milyon": "milyonuncu", "son": "sonuncu",
}

# Nouns used as postpositions, by root.
POSTPOSITIONS = {
    "iç": "içinde içine içinden içini içinin içindeki",
    "üzer": "üzerinde üzerine üzerinden üzerindeki",
    "yer": "yerine yerinde yerinden yerindeki",
    "yan": "yanında yanına yanından yanındaki",
    "alt": "altında altına altından altındaki",
    "üst": "üstünde üstüne üstünden üstündeki",
    "baş": "başında başına başından başındaki",
    "hak": "hakkında hakkını hakkındaki hakkının hakkına",
    "yüz": "yüzde yüzden yüzünden yüzüne",
    "ön": "önünde önüne önünden önündeki",
    "arka": "arkasında arkasına arkasından arkasındaki",
    "ara": "arasında arasına arasından arasındaki",
}

# Irregular verb stems, by verb.
VERB_STEMS = {
    "de": "ded di diy diye diyel der den deni denil demem",
    "ye": "yi yiy yiye yiyel yemem yememem yemeyel",
    "et": "ed eder edi edil eden edebil",
    "git": "gid gider gidi gidil",
}

# Verbs that look derived but are words of their own.
OWN_RECIPROCALS = frozenset("çalış konuş oluş değiş karış görüş dönüş yetiş alış buluş geliş çatış tartış bakış sıkış yakış iniş içiş öpüş gülüş uçuş kızış doluş akış savaş barış tanış yarış".split())
OWN_VERBS = frozenset("anlat yat yarat eksilt yut yücelt yoğurt dinlen dayan sun seslen bürün dokun eğlen ilgilen diren değerlen sonuçlan kaldır takıl bayıl yanıl yatır soruştur".split())

# Endings that derive verbs, in the order in which they are tried.
VERB_ENDINGS = "dır dir dur dür tır tir tur tür ıl il ul ül ış iş uş üş t n".split()

# Fixed values: (inner, outer) labels that never follow each other.
FORBIDDEN = [
    ("SIFAT_FİİL", "KİŞİ_1Ç"), ("SIFAT_FİİL", "KİŞİ_2Ç"), ("SIFAT_FİİL", "İYELİK_3T/BELIRTME"), ("SIFAT_FİİL", "BULUNMA"),
    ("GENİŞ_ZAMAN", "YÖNELME"), ("GENİŞ_ZAMAN", "AYRILMA"), ("GENİŞ_ZAMAN", "İYELİK_3Ç"), ("GENİŞ_ZAMAN", "İYELİK_3T/BELIRTME"), ("GENİŞ_ZAMAN", "İYELİK_1Ç"),
    ("GEÇMİŞ_ZAMAN", "AYRILMA"), ("GEÇMİŞ_ZAMAN", "YÖNELME"), ("KİŞİ_1Ç", "İYELİK_2T/TAMLAYAN"),
    ("EDİLGEN", "İYELİK_3Ç"), ("EDİLGEN", "KİŞİ_1Ç"), ("EDİLGEN", "ÇOĞUL"), ("YAPIM_-lI", "ŞİMDİKİ_ZAMAN"),
    ("YAPIM_-CI", "AYRILMA"), ("YÖNELME", "YAPIM_-lI"), ("ZARF_FİİL_-IncA", "ÇOĞUL"),
]

# Groups of labels.
VERBAL = frozenset(
    "GENİŞ_ZAMAN GENİŞ_ZAMAN_OLMSZ GEÇMİŞ_ZAMAN DUYULAN_GEÇMİŞ GELECEK_ZAMAN ŞİMDİKİ_ZAMAN SIFAT_FİİL SIFAT_FİİL_-DIk SIFAT_FİİL_-DIğ ZARF_FİİL_-ArAk ZARF_FİİL_-IncA "
    "ZARF_FİİL_-Ip ZARF_FİİL_-ken EDİLGEN İŞTEŞ ETTİRGEN_-lAt YETERLİLİK OLUMSUZ/İSİM_FİİL DİLEK_ŞART BİLDİRME/ETTİRGEN EMİR/KİŞİ_2T EMİR_3Ç KİŞİ_2Ç KİŞİ_1Ç MASTAR".split()
)
VERB_FINAL = frozenset("GEÇMİŞ_ZAMAN DUYULAN_GEÇMİŞ GELECEK_ZAMAN ŞİMDİKİ_ZAMAN GENİŞ_ZAMAN GENİŞ_ZAMAN_OLMSZ DİLEK_ŞART KİŞİ_1T KİŞİ_2T KİŞİ_1Ç KİŞİ_2Ç KİŞİ_3Ç EMİR EMİR_3Ç BİLDİRME MASTAR".split())
BUFFERED_BY_N = frozenset("AYRILMA TAMLAYAN YÖNELME BELIRTME".split())
CASES = frozenset("BULUNMA AYRILMA YÖNELME BELIRTME".split())


def inverted(by_root: dict[str, str]) -> dict[str, str]:
    return {surface: root for root, surfaces in by_root.items() for surface in surfaces.split()}
