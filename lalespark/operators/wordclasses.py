"""Fixed word lists and label groups of the sentence operators."""

from __future__ import annotations

# Word lists by class.
DETERMINERS = "bir bu şu o her bazı birçok tüm bütün hiçbir birkaç kimi öbür öteki hangi kaç"
CONJUNCTIONS = "ve veya ya ama fakat ancak ile ne hem oysa hâlbuki halbuki gerek yani örneğin hatta eğer"
ALWAYS_CONJUNCTIONS = "veya ama fakat ancak oysa hâlbuki halbuki yani hatta"
CASE_POSTPOSITIONS = "için gibi kadar göre karşı rağmen dair üzere doğru dolayı itibaren beri hakkında ait ilişkin karşın boyunca önce sonra olarak diye"
ADVERBS = (
    "çok az daha en pek hiç hep artık biraz epey fazla aşırı iyice hayli oldukça gayet dün bugün yarın şimdi sonra önce hemen yine tekrar bazen sık geç erken henüz hâlâ hala zaten "
    "sürekli daima devamlı nihayet sonunda derhal önceden böyle şöyle öyle birlikte beraber doğrudan açıkça işte gerçekten aslında genellikle mutlaka kesinlikle muhakkak elbette tabii "
    "neredeyse herhalde yeterince bile sadece yalnız ancak özellikle yalnızca belki acaba nasıl asla içeri dışarı ileri geri burada orada şurada buraya oraya şuraya buradan oradan şuradan "
    "nerede nereye nereden üstelik ayrıca dahası böylece tamamen yeniden sanki ardından sonradan baştan meselâ mesela yıllarca birdenbire öylece aheste usul yavaş peki sizce nedense meğerse yoktu çabuk"
)
NOUNS = (
    "zaman başkan ozan divan meydan kazan düzen neden güven yüzen başbakan hayran bilim eğitim geçim toplum hücum önlem eylem devam teslim temsil yatırım ikram yaşam üretim işlem program dilim "
    "karar pazar sınır şeker kültür değer hayır asır artış bakış çıkış giriş dönüş yürüyüş buluş takip sahip yemek tarafından bakımından yüzünden yönünden vardır yoktur akşam parmak albüm "
    "helikopter deniz politika yardım bölge dahil insan adam tahmin talep taraf kereviz satanizm kader yüzden aslan şehir bayram zafer kasım sultan hanım kilise giyecek astım esmer baldır ayran "
    "düşünce reform deprem biber potasyum duman kibir katılım leopar sonbahar kalorifer huzur lüfer karabiber kırmızıbiber sekreter önder sevecen karakteristik cezasız devlet güney mayıs mart "
    "meclis genelkurmay cumhurbaşkan savcı dışişleri bakan gönül kurul tatil varil tahıl cahil yan gün yıl su ateş kapı yer sıra otel anne baba kız"
)
NUMERALS = "iki üç dört beş altı yedi sekiz dokuz on yirmi otuz kırk elli altmış yetmiş seksen doksan yüz bin milyon milyar trilyon sıfır birinci ikinci üçüncü dördüncü beşinci altıncı yedinci sekizinci dokuzuncu onuncu birer ikişer üçer beşer onar yüzde"
VERB_FORMS = "olan olur oldu olsa olsun olursa olurdu olmuştu olma olduğuna olursunuz eden eder etmeye ettiler etmişti dedi der dedim diyorum açan kaldı alır açar bakın edin girdi inceldi verdi sürdü istedi istedim vermeye gerekirse korka doya iken"
TIMES = "sabah öğle öğlen akşam gece gündüz hafta ay yıl sene mevsim pazar pazartesi salı çarşamba perşembe cuma cumartesi ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık bahar yaz sonbahar kış"
CLAUSE_SUBJECT_HEADS = "lazım lâzım gerekli gereklidir şart önemli önemlidir güç zor kolay mümkün olanaksız olanaksızdır imkansız imkânsız gerçek gerçektir doğru yanlış mutlu normal tesadüf tesadüftü belli"
LIGHT_VERBS = "et yap ol kıl buyur eyle"
PRONOUNS = (
    "ben sen biz siz beni bana bende benden benim benimle seni sana sende senden senin seninle onu ona onda ondan onun onunla bizi bize bizde bizden bizim bizimle sizi size sizde sizden sizin sizinle "
    "onlar onları onlara onlarda onlardan onların bunu bunun buna bundan bunla bununla bunlar bunları bunların bunlara bunlarda bunlardan şunu şunun şuna şundan şununla şunlar şunları şunların şunlara şunlarda "
    "kendi kendisi kendim kendin kendimiz kendiniz kendisine kendisini kendisinin kendisinden kendisiyle kendime kendimi kendimin kendimden kendimle kendine kendini kendinin kendinden kendinle kendileri kendilerine kendilerini kendilerinin "
    "kim kimi kime kimde kimden kimin kimse ne neyi neye nede neden neyin neler neleri nelere nelerden nelerin nere nereye nerede nereden nereyi nerenin buraya burada buradan burayı buranın şuraya şurada şuradan "
    "oraya orada oradan orayı oranın herkes herkesi herkese herkeste herkesten herkesin hepsi hepsini hepsine hepsinden hepsinin hepimiz hepiniz hiçbiri hiçbirini hiçbirine hiçbirinden hiçbirinin "
    "birisi birisine birisini birisinin biri birini birine birinde birinden birinin birbirimiz birbiri birbirine birbirini birbirinin birbirinden birbirlerini birbirlerine hangisi hangileri hangisine hangisini"
)
PRONOUN_STEMS = "ben sen o biz siz onlar kendi kim ne nere bura şura ora bun şun herkes hep hiçbir biri birbir hangi"
QUESTIONS = "mi mı mu mü mısın misin musun müsün mıyız miyiz muyuz müyüz mısınız misiniz musunuz müsünüz midir mıdır mıydı miydi muydu müydü mıymış miymiş muymuş müymüş"
FOCUS = "de da ki"
EMPHASIS = "de da bile dahi sadece yalnızca özellikle yalnız"
INTERJECTIONS = "evet hayır tamam peki hay eyvah oh ah vah bravo aman maalesef lütfen merhaba güle haydi hadi hey ey sakın hooop tey ha aaa tabi"
SUBORDINATORS = "ki diye çünkü madem mademki şayet oysaki"

# Word lists of reranking, which are shorter than those above.
NEAR_CONJUNCTIONS = "ve ama fakat ancak veya ya ile ki de da"
NEAR_ADJECTIVES = "yeni eski büyük küçük güzel iyi kötü doğal yapay ilk son önemli farklı uzun kısa genç yaşlı ağır hafif"
NEAR_POSTPOSITIONS = "için gibi kadar göre karşı rağmen dair üzere doğru dolayı itibaren beri hakkında ait ilişkin karşın boyunca önce sonra"
NEAR_NUMERALS = "iki üç dört beş altı yedi sekiz dokuz on yirmi otuz kırk elli altmış yetmiş seksen doksan yüz bin milyon milyar"

# Words of single rules.
GENITIVE_PRONOUNS = "benim senin onun bizim sizin onların bunun şunun bunların şunların kendi kendinin kendisinin"
ACCUSATIVE_PRONOUNS = "beni seni onu bizi sizi onları bunu şunu bunları şunları kendini kendisini kendilerini birini hiçbirini hepsini herşeyi ne"
SPEECH = "dedi dedim dedin dedik dediniz dediler demiş demişti demişler"
COPULAS = "değil değildir değildi değilmiş değilim değilsin değiliz değilsiniz değiller idi imiş ise"
CORRELATIVES = "hem ne ya ister gerek olsun"
NOT_OL = "olay olağan olağanüstü olası olasılık oluşum olgu oluk olumlu olumsuz olarak"
NOT_LIGHT = "olarak yapısı yapısını yapısının yapısında yapılan yapılır yapılmış etik etiket"
PAIRS = "paldır-küldür konu-komşu toz-duman saç-sakal had-hesap dolap-molap kaba-saba yer-gök aşağı-yukarı yaşam-zor bağır-çağır ol-bit"

# Labels and their features.
CASE = {"BELIRTME": "Acc", "YÖNELME": "Dat", "BULUNMA": "Loc", "AYRILMA": "Abl", "TAMLAYAN": "Gen", "ARAÇ": "Ins", "VASITA": "Ins"}
TENSE = {"GEÇMİŞ_ZAMAN": "Past", "DUYULAN_GEÇMİŞ": "Evi", "ŞİMDİKİ_ZAMAN": "Pres", "GELECEK_ZAMAN": "Fut", "GENİŞ_ZAMAN": "Aor", "GENİŞ_ZAMAN_OLMSZ": "Aor"}
PERSON = {"KİŞİ_1T": ("1", "Sing"), "KİŞİ_2T": ("2", "Sing"), "KİŞİ_1Ç": ("1", "Plur"), "KİŞİ_2Ç": ("2", "Plur"), "KİŞİ_3Ç": ("3", "Plur")}
PARTICIPLES = "SIFAT_FİİL SIFAT_FİİL_-DIk SIFAT_FİİL_-DIğ"
CONVERBS = "ZARF_FİİL_-ArAk ZARF_FİİL_-IncA ZARF_FİİL_-Ip ZARF_FİİL_-ken"
VERBAL_NOUNS = "MASTAR İSİM_FİİL İŞTEŞ EDİLGEN ETTİRGEN"
POSSESSIVES = "İYELİK_1T İYELİK_2T İYELİK_3T İYELİK_1Ç İYELİK_2Ç İYELİK_3Ç"
NOT_WITH_DIR = "GEÇMİŞ_ZAMAN GENİŞ_ZAMAN ŞİMDİKİ_ZAMAN GELECEK_ZAMAN DUYULAN_GEÇMİŞ KİŞİ_1T KİŞİ_2T KİŞİ_3T KİŞİ_1Ç KİŞİ_2Ç KİŞİ_3Ç EMIR İSTEK GEREK ŞART SIFAT_FİİL ZARF_FİİL İSİM_FİİL_-mA İSİM_FİİL_-Iş MASTAR YETERLİLİK OLUMSUZ"

# Shapes of word forms, all in lower case.
SHAPES = {
    "converb": r"[aeıioöuü]rken$|[ıiuü]nc[ae]$|m[ae]d[ae]n$|[dt][ıiuü]k[çc][ae]$",
    "adjective": r".{3,}l[ıiuü]$|.{2,}s[ıiuü]z$|.{2,}s[ae]l$|.{3,}[ıiuü]ms[ıiuü]$",
    "located": r".{2,}[dt][ae]ki$",
    "past": r".{3,}yord[uü]$|.{3,}m[ıiuü]şt[ıiuü]$|.{3,}[aeıioöuü]r[dt][ıiuü]$|.{4,}y[dt][ıiuü]$|.{3,}[aeıioöuü]lm[ıiuü]ş$",
    "evidential": r".{2,}m[ıiuü]ş$",
    "nominalised": r"[dt][ıiuü][ğk]|[ea]c[ea][ğk]|m[ea]s[ıiuü]|m[ea]y[ıiuü]|m[ea]l[ıiuü]|[ıiuü]labil",
    "light_noun": r"^(et|yap|ol|kıl|buyur|eyle)(me|ma|iş|ış|uş|üş)",
    "report": r"^(belirtil|öğrenil|bilin|bildiril|kararlaştırıl|denil|anlaşıl|söylen|kaydedil|vurgulan|açıklan|saptanıl)",
    "wanting": r"^ist(?:e|i|iy|ed|ey)",
    "ordinal": r"[ıiuü]nc[ıiuü]$|'?nc[ıiuü]$|^(birinci|ikinci|üçüncü|dördüncü|beşinci|altıncı|yedinci|sekizinci|dokuzuncu|onuncu|sonuncu)$",
    "distributive": r"^(birer|ikişer|üçer|dörtler|beşer|altışar|yedişer|sekizer|dokuzar|onar|yirmişer)$",
    "future": r"[aeıiuüoö]c[ae]k$",
}
#: The base of an adjective form, tried in this order.
ADJECTIVE_BASES = [r"^(.{3,})l[ıiuü]$", r"^(.{2,})s[ıiuü]z$", r"^(.{3,})s[ae]l$", r"^(.{3,})[ıiuü]ms[ıiuü]$"]
#: Endings of the ablative, longest first.
ABLATIVES = [r"l[ae]r[ıiuü]nd[ae]n$", r"s[ıiuü]nd[ae]n$", r"[ıiuü]nd[ae]n$", r"l[ae]rd[ae]n$", r"nd[ae]n$", r"d[ae]n$", r"t[ae]n$"]


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())
