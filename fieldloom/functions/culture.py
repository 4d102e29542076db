"""Cultures: separators, names of months and days, list separators. Spark formats dates in one session locale, so names
come from here."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Culture:
    name: str
    decimal: str = "."
    group: str = ","
    list_separator: str = ","
    currency: str = "$"
    months: str = "January February March April May June July August September October November December"
    months_short: str = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"
    days: str = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday"
    days_short: str = "Sun Mon Tue Wed Thu Fri Sat"
    am_pm: str = "AM PM"
    #: Pictures of the default texts of a date and a time.
    date_time: str = "M/d/yyyy h:mm:ss AM/PM"

    @property
    def language(self) -> str:
        return self.name.split("-")[0].lower()

    def upper(self, text: Column) -> Column:
        return F.upper(F.translate(text, "iı", "İI") if self.language in ("tr", "az") else text)

    def lower(self, text: Column) -> Column:
        return F.lower(F.translate(text, "Iİ", "ıi") if self.language in ("tr", "az") else text)


EN = Culture("en-US")
#: Names and separators by language, as cultures define them.
_DE = Culture("de-DE", ",", ".", ";", "€", "Januar Februar März April Mai Juni Juli August September Oktober November Dezember", "Jan Feb März Apr Mai Juni Juli Aug Sept Okt Nov Dez", "Sonntag Montag Dienstag Mittwoch Donnerstag Freitag Samstag", "So Mo Di Mi Do Fr Sa", "AM PM", "dd.MM.yyyy HH:mm:ss")
_FR = Culture("fr-FR", ",", " ", ";", "€", "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "janv. févr. mars avr. mai juin juil. août sept. oct. nov. déc.", "dimanche lundi mardi mercredi jeudi vendredi samedi", "dim. lun. mar. mer. jeu. ven. sam.", "AM PM", "dd/MM/yyyy HH:mm:ss")
_ES = Culture("es-ES", ",", ".", ";", "€", "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "ene feb mar abr may jun jul ago sept oct nov dic", "domingo lunes martes miércoles jueves viernes sábado", "dom lun mar mié jue vie sáb", "a.m. p.m.", "d/M/yyyy H:mm:ss")
_IT = Culture("it-IT", ",", ".", ";", "€", "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre", "gen feb mar apr mag giu lug ago set ott nov dic", "domenica lunedì martedì mercoledì giovedì venerdì sabato", "dom lun mar mer gio ven sab", "AM PM", "dd/MM/yyyy HH:mm:ss")
_PT = Culture("pt-PT", ",", " ", ";", "€", "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro", "jan. fev. mar. abr. mai. jun. jul. ago. set. out. nov. dez.", "domingo segunda-feira terça-feira quarta-feira quinta-feira sexta-feira sábado", "domingo segunda terça quarta quinta sexta sábado", "da manhã da tarde", "dd/MM/yyyy HH:mm:ss")
_DA = Culture("da-DK", ",", ".", ";", "kr.", "januar februar marts april maj juni juli august september oktober november december", "jan. feb. mar. apr. maj jun. jul. aug. sep. okt. nov. dec.", "søndag mandag tirsdag onsdag torsdag fredag lørdag", "søn. man. tirs. ons. tors. fre. lør.", "AM PM", "dd.MM.yyyy HH.mm.ss")
_FI = Culture("fi-FI", ",", " ", ";", "€", "tammikuu helmikuu maaliskuu huhtikuu toukokuu kesäkuu heinäkuu elokuu syyskuu lokakuu marraskuu joulukuu", "tammi helmi maalis huhti touko kesä heinä elo syys loka marras joulu", "sunnuntai maanantai tiistai keskiviikko torstai perjantai lauantai", "su ma ti ke to pe la", "ap. ip.", "d.M.yyyy H.mm.ss")
_EL = Culture("el-GR", ",", ".", ";", "€", "Ιανουάριος Φεβρουάριος Μάρτιος Απρίλιος Μάιος Ιούνιος Ιούλιος Αύγουστος Σεπτέμβριος Οκτώβριος Νοέμβριος Δεκέμβριος", "Ιαν Φεβ Μάρ Απρ Μάι Ιούν Ιούλ Αύγ Σεπ Οκτ Νοέ Δεκ", "Κυριακή Δευτέρα Τρίτη Τετάρτη Πέμπτη Παρασκευή Σάββατο", "Κυρ Δευ Τρί Τετ Πέμ Παρ Σάβ", "π.μ. μ.μ.", "d/M/yyyy h:mm:ss AM/PM")
_JA = Culture("ja-JP", ".", ",", ",", "￥", " ".join(f"{i}月" for i in range(1, 13)), " ".join(f"{i}月" for i in range(1, 13)), "日曜日 月曜日 火曜日 水曜日 木曜日 金曜日 土曜日", "日 月 火 水 木 金 土", "午前 午後", "yyyy/MM/dd H:mm:ss")
_ZH = Culture("zh-CN", ".", ",", ",", "¥", "一月 二月 三月 四月 五月 六月 七月 八月 九月 十月 十一月 十二月", " ".join(f"{i}月" for i in range(1, 13)), "星期日 星期一 星期二 星期三 星期四 星期五 星期六", "周日 周一 周二 周三 周四 周五 周六", "上午 下午", "yyyy/M/d HH:mm:ss")
_TH = Culture("th-TH", ".", ",", ",", "฿", "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม", "ม.ค. ก.พ. มี.ค. เม.ย. พ.ค. มิ.ย. ก.ค. ส.ค. ก.ย. ต.ค. พ.ย. ธ.ค.", "วันอาทิตย์ วันจันทร์ วันอังคาร วันพุธ วันพฤหัสบดี วันศุกร์ วันเสาร์", "อา. จ. อ. พ. พฤ. ศ. ส.", "AM PM", "d/M/yyyy HH:mm:ss")
_TR = Culture("tr-TR", ",", ".", ";", "₺", "Ocak Şubat Mart Nisan Mayıs Haziran Temmuz Ağustos Eylül Ekim Kasım Aralık", "Oca Şub Mar Nis May Haz Tem Ağu Eyl Eki Kas Ara", "Pazar Pazartesi Salı Çarşamba Perşembe Cuma Cumartesi", "Paz Pzt Sal Çar Per Cum Cmt", "ÖÖ ÖS", "d.MM.yyyy HH:mm:ss")
CULTURES = {c.language: c for c in (EN, _DE, _FR, _ES, _IT, _PT, _DA, _FI, _EL, _JA, _ZH, _TH, _TR)}


def culture(name: str | Culture | None) -> Culture:
    """By name such as ``fr-CA``: the language's conventions under that name; unknown languages have the English ones."""
    if isinstance(name, Culture):
        return name
    base = CULTURES.get((name or "en-US").split("-")[0].lower(), EN)
    return replace(base, name=name) if name else base
