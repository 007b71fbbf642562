"""Queries on XML documents that Spark writes from the given tables and the builders read back."""

from pyspark.sql import functions as F

from plenum import bindings as b
from plenum import schemas
from plenum.catalog.bits import SPEECHES, with_
from plenum.functions.markup import law_changes
from plenum.operators.resolve import resolve_signers
from plenum.plans import documents as doc
from plenum.plans import minutes, people
from plenum.plans.chamber import build_absences
from plenum.sources.readers import widen, xml_path


# Tasks in which the documents of a split of the orders, some millions, are made and read.
TASKS = 16


def _iso(col):
    return F.date_format(col, "yyyy-MM-dd")


def _el(tag, *content):
    return F.concat(F.lit(f"<{tag}>"), *[F.lit(c) if isinstance(c, str) else c for c in content],
                    F.lit(f"</{tag.split()[0]}>"))


def _esc(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _if(cond, value):
    return F.when(cond, value).otherwise(F.lit(""))


# --- the member register: one document per order ------------------------------------------


def member_xml(s, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "d.M.yyyy")
    number, prio = k.cast("string"), F.col("o_orderpriority")

    def period(start, end, role):
        return _el("Jasenyys", _el("AlkuPvm", start), _el("LoppuPvm", end), _el("Rooli", role))

    seats = F.concat(
        F.when(k % 2 == 0, F.lit('<Toimielin OnkoValiokunta="true">')).otherwise(F.lit('<Toimielin OnkoValiokunta="false">')),
        _el("Nimi", "Committee ", prio), period("1996", "1998", "Varajäsen"), period(day, "", "puheenjohtaja"),
        F.lit("</Toimielin>"),
    )
    former = F.concat(
        F.lit('<Toimielin OnkoValiokunta="true">'), _el("Nimi", "Suuri valiokunta"), period(day, "1999", "jäsen"),
        F.lit("</Toimielin>"),
    )
    xml = _el(
        "Henkilo",
        _el("HenkiloNro", number), _el("Etunimet", "F", number), _el("Sukunimi", prio), "<A/><B/><C/>",
        _el("Puhelin", "09 ", number), _el("Sahkoposti", _if(k % 2 == 0, F.concat(number, F.lit("@x.fi")))), "<D/>",
        _el("Ammatti", F.col("o_orderstatus")), _el("SyntymaVuosi", F.year("o_orderdate").cast("string")),
        _el("Syntymapaikka", "Place"), "<E/><G/><H/>", _el("Kotikunta", "Home ", prio),
        _el("KansanedustajuusPaattynytPvm", F.when(k % 3 == 0, day).when(k % 3 == 1, "14.1.2011").otherwise("")),
        _el("Sidonnaisuudet", _el("Sidonnaisuus", _el("RyhmaOtsikko", "Tulot"), _el("Sidonta", schemas.NOTHING_TO_DECLARE[1])),
            _if(k % 2 == 1, _el("Sidonnaisuus", _el("RyhmaOtsikko", "Lahjat"), _el("Sidonta", "x ", number)))),
        _el("Eduskuntaryhmat",
            _el("NykyinenEduskuntaryhma", _el("Nimi", _if(k % 4 == 0, F.lit("Vihreä eduskuntaryhmä"))), _el("AlkuPvm", day)),
            _el("EdellisetEduskuntaryhmat", _el("Eduskuntaryhma", _el("Nimi", prio), period(day, "1.2.2005", ""),
                                               period("28.12.2006", "", "")))),
        _el("NykyisetToimielinjasenyydet", seats), _el("AiemmatToimielinjasenyydet", former),
        _el("Muut", _el("ValtioneuvostonJasenyydet",
            _el("Jasenyys", _el("Nimi", "Minister ", prio), _el("Ministeriys", _if(k % 5 == 0, F.lit("Ministry"))),
                _el("Hallitus", "Cabinet"), _el("AlkuPvm", "1995"), _el("LoppuPvm", day)))),
    )
    return widen(b.table(s, d, "orders"), TASKS).select(
        k.cast("int").alias("personId"), F.concat(F.lit(" "), prio).alias("lastname"),
        F.concat(F.lit("F"), number, F.lit(" ")).alias("firstname"), xml.alias("XmlDataFi"),
    )


DAY = "strftime(o_orderdate, '%Y-%m-%d')"


# --- minutes: one document per conversation and thousand turns, the thousands being years -----------


def minutes_xml(s, d):
    """Each turn is a speech; the system is an official, the assistant a minister who replies."""
    t = b.table(s, d, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    paras = F.array_join(F.transform(F.split(_esc(F.col("text")), "\n"), lambda p: F.concat(
        F.lit("<sis:KappaleKooste>"), p, F.lit("</sis:KappaleKooste>"))), "")
    speech = F.concat(
        F.lit('<vsk:PuheenvuoroToimenpide vsk1:puheenvuoroLuokitusKoodi="T" vsk1:puheenvuoroAloitusHetki="2024-01-15T10:'),
        F.lpad((turn % 60).cast("string"), 2, "0"), F.lit(':00">'),
        F.lit('<org:Henkilo met1:muuTunnus="'), F.pmod(conv * 7 + turn * 3, F.lit(100)).cast("string"), F.lit('">'),
        F.when(F.col("role") == "system", F.lit("<org1:AsemaTeksti>pääsihteeri</org1:AsemaTeksti>"))
        .when(F.col("role") == "assistant", F.lit("<org1:AsemaTeksti>pääministeri</org1:AsemaTeksti>")).otherwise(""),
        F.lit("</org:Henkilo>"),
        _if(F.col("role") == "assistant", F.lit(f"<vsk1:TarkenneTeksti>{schemas.RESPONSE_NOTE}</vsk1:TarkenneTeksti>")),
        F.lit('<vsk:PuheenvuoroOsa met1:muuTunnus="'), conv.cast("string"), F.lit("."), turn.cast("string"), F.lit('">'),
        paras,
        _if(turn % 2 == 0, F.lit(
            "<vsk:PuheenjohtajaRepliikki><vsk1:PuheenjohtajaTeksti>Puhemies</vsk1:PuheenjohtajaTeksti>"
            "<sis:KappaleKooste>Kiitos!</sis:KappaleKooste></vsk:PuheenjohtajaRepliikki>")),
        F.lit("</vsk:PuheenvuoroOsa></vsk:PuheenvuoroToimenpide>"),
    )
    docs = t.select("conv_id", F.floor(turn / 1000).alias("block"), F.struct("turn", speech.alias("speech")).alias("x")).groupBy(
        "conv_id", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    number, year = conv.cast("string"), lambda first: (F.lit(first) + F.col("block")).cast("string")
    xml = F.concat(
        F.lit('<ns11:Siirto><jme:JulkaisuMetatieto met1:laadintaPvm="2024-01-16" met1:eduskuntaTunnus="PTK '), number,
        F.lit("/"), year(2024), F.lit(' vp"/><asi:EduskuntaTunniste><met1:AsiakirjatyyppiKoodi>'),
        F.when(F.col("conv_id") % 5 == 0, "HaVP").otherwise("PTK"),
        F.lit("</met1:AsiakirjatyyppiKoodi><asi1:AsiakirjaNroTeksti>"), number,
        F.lit("</asi1:AsiakirjaNroTeksti><asi1:ValtiopaivavuosiTeksti>"), year(2024), F.lit("</asi1:ValtiopaivavuosiTeksti>"
              "</asi:EduskuntaTunniste><ptk:Poytakirja "),
        _if(F.col("conv_id") % 3 != 0, F.lit('vsk1:kokousAloitusHetki="2024-01-15T10:00:00" ')),
        F.lit('tila="x"><vsk:MuuAsiakohta><vsk:KohtaAsiakirja vsk1:hyperlinkkiKoodi="EDK-'), number,
        F.lit('"><met1:AsiakirjatyyppiNimi>Nimenhuutoraportti 1</met1:AsiakirjatyyppiNimi></vsk:KohtaAsiakirja>'
              '</vsk:MuuAsiakohta><vsk:Asiakohta '),
        F.when(F.col("conv_id") % 2 == 0, F.lit("met1:eduskuntaTunnus")).otherwise(F.lit("met1:muuTunnus")),
        F.lit('="HE '), number, F.lit("/"), year(2023), F.lit(' vp"><vsk:KohtaNimeke><met1:NimekeTeksti>Asia  -— '), number,
        F.lit("\n </met1:NimekeTeksti></vsk:KohtaNimeke>"),
        F.array_join(F.transform("xs", lambda x: x["speech"]), ""),
        F.lit("</vsk:Asiakohta></ptk:Poytakirja></ns11:Siirto>"),
    )
    return docs.select(xml.alias("XmlData"))


THREADED = SPEECHES + """,
threaded AS (
  SELECT *, coalesce(last_value(CASE WHEN is_root THEN turn_id END IGNORE NULLS) OVER (
      PARTITION BY item_id, pos // 1000 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), turn_id) AS response_to
  FROM (SELECT *, '2024/' || item_id || '.' || pos AS turn_id FROM speeches WHERE role <> 'system'))"""

STRIP = "regexp_replace(x, '^[\\s\\p{Z}\\x{0b}\\x{85}]+|[\\s\\p{Z}\\x{0b}\\x{85}]+$', '', 'g')"


# --- proposals: one document per order and thousand line numbers (years), signed by these lines ------


def proposal_xml(s, d, body="eka:EduskuntaAloite"):
    li = b.table(s, d, "lineitem").join(
        b.supplier_persons(s, d).withColumnRenamed("id", "l_suppkey"), "l_suppkey"
    )
    n = F.col("l_linenumber")
    who = F.concat(
        F.lit("<org:Henkilo"),
        F.when(n == 1, F.concat(F.lit(' met1:muuTunnus="'), F.col("l_suppkey").cast("string"), F.lit('"')))
        .when(n == 2, F.lit(' met1:muuTunnus="*"')).otherwise(""),
        F.lit("><org1:EtuNimi>"), F.when(n == 3, "").when(n == 6, "Nobody").otherwise(F.upper("first_name")),
        F.lit("</org1:EtuNimi><org1:SukuNimi>"), F.col("last_name"), F.when(n == 4, " vihr").otherwise(""),
        F.lit("</org1:SukuNimi></org:Henkilo>"),
    )
    signer = F.concat(
        F.lit("<asi:Allekirjoittaja"),
        _if(n == 1, F.lit(f' asi1:allekirjoitusLuokitusKoodi="{schemas.FIRST_SIGNER_CLASS}"')),
        F.lit(">"), who, F.lit("</asi:Allekirjoittaja>"),
    )
    signed = li.select(
        "l_orderkey", F.floor(n / 1000).alias("block"), F.struct("l_linenumber", "l_partkey", "l_suppkey", signer.alias("signer")).alias("x")
    ).groupBy("l_orderkey", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    orders = b.table(s, d, "orders")
    # Adaptive execution would join these narrow rows, which become long documents, in a few tasks.
    splits = max(s.sparkContext.defaultParallelism, sum(t.rdd.getNumPartitions() for t in (orders, b.table(s, d, "lineitem"))))
    o = orders.join(signed, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "block", "xs"
    ).repartition(splits * TASKS, "o_orderkey", "block", "o_custkey", "o_orderdate")
    number, year = F.col("o_orderkey").cast("string"), (F.lit(2024) + F.coalesce("block", F.lit(0))).cast("string")
    whole = F.concat(
        F.lit(f"<{body}><met:Nimeke><met1:NimekeTeksti>Aloite "), number, F.lit("</met1:NimekeTeksti></met:Nimeke>"
              "<asi:AsiaKuvaus><sis:KappaleKooste>Tiivis "), F.col("o_orderpriority"),
        F.lit("</sis:KappaleKooste></asi:AsiaKuvaus><asi:PerusteluOsa><asi:PerusteluLuku><sis1:OtsikkoTeksti>YLEISTÄ"
              "</sis1:OtsikkoTeksti><sis:KappaleKooste>Summa <sis1:LihavaTeksti> "), F.col("o_orderstatus"),
        F.lit(" </sis1:LihavaTeksti>on</sis:KappaleKooste></asi:PerusteluLuku></asi:PerusteluOsa>"
              "<asi:PonsiOsa><sis:SuppeaLista ns2:ulkoasuKoodi=\"Viiva\"><sis:KappaleKooste>ponsi "), number,
        F.lit("</sis:KappaleKooste></sis:SuppeaLista></asi:PonsiOsa><saa:SaadosOsa><saa:Saados>"
              "<saa:SaadostyyppiKooste>Laki</saa:SaadostyyppiKooste><saa:SaadosNimekeKooste>asiasta</saa:SaadosNimekeKooste>"
              "<saa:Johtolause><saa:SaadosKappaleKooste>muutetaan</saa:SaadosKappaleKooste></saa:Johtolause><saa:Pykala>"
              "<saa:PykalaTunnusKooste>"), number,
        F.lit(" §</saa:PykalaTunnusKooste><saa:MomenttiKooste>Momentti.</saa:MomenttiKooste><saa:KohdatMomentti>"
              "<saa:MomenttiJohdantoKooste>Ovat:</saa:MomenttiJohdantoKooste><saa:MomenttiKohtaKooste>1) yksi"
              "</saa:MomenttiKohtaKooste></saa:KohdatMomentti></saa:Pykala></saa:Saados></saa:SaadosOsa>"),
        F.coalesce(F.array_join(F.transform("xs", lambda x: x["signer"]), ""), F.lit("")),
        F.lit(f"</{body}>"),
    )
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(
            F.lit('<ns11:Siirto><jme:JulkaisuMetatieto met1:laadintaPvm="'), F.date_format("o_orderdate", "yyyy-MM-dd"),
            F.lit('" met1:eduskuntaTunnus="LA '), number, F.lit("/"), year, F.lit(' vp"/>'), _if(F.col("o_orderkey") % 9 != 0, whole),
            F.lit("</ns11:Siirto>"),
        ).alias("XmlData"),
    )


def handling_xml(s, d):
    number = F.col("o_orderkey").cast("string")
    code = F.when(F.col("o_orderstatus") == "F", "PassedUrgent").when(F.col("o_orderstatus") == "P", "Resting")
    blocks = b.table(s, d, "lineitem").select("l_orderkey", F.floor(F.col("l_linenumber") / 1000).alias("block")).distinct()
    docs = b.table(s, d, "orders").join(blocks, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    year = (F.lit(2024) + F.coalesce("block", F.lit(0))).cast("string")
    return docs.select(
        number.alias("Id"), F.concat(F.lit("LA "), number, F.lit("/"), year, F.lit(" vp")).alias("Eduskuntatunnus"),
        F.concat(
            F.lit("<x>"),
            F.when(code.isNotNull(), F.concat(
                F.lit('<vsk:EduskuntakasittelyPaatosKuvaus vsk1:eduskuntakasittelyPaatosKoodi="'), code, F.lit('"/>'))
            ).otherwise(""),
            F.lit("</x>"),
        ).alias("XmlData"),
    )


LAW_TEXT = (
    "'# Laki asiasta' || chr(10) || chr(10) || chr(10) || 'muutetaan' || chr(10) || chr(10) || '**' || o_orderkey || ' §**' "
    "|| chr(10) || chr(10) || 'Momentti.' || chr(10) || chr(10) || 'Ovat:' || chr(10) || chr(10) || '- 1) yksi'"
)
DOCS = """docs AS (
  SELECT o.*, coalesce(block, 0) AS block, o_orderkey || '/' || (2024 + coalesce(block, 0)) || ' vp' AS tail
  FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber // 1000 AS block FROM lineitem) ON l_orderkey = o_orderkey)"""
SIGNED = """SELECT 'la ' || l_orderkey || '/' || (2024 + l_linenumber // 1000) || ' vp' AS {key}, l_suppkey AS person_id, max((l_linenumber = 1)::INT) AS first
FROM lineitem WHERE l_linenumber NOT IN (2, 3, 6) AND l_orderkey % 9 <> 0 GROUP BY 1, 2"""


def report_xml(s, d):
    """Committee reports: one objection each, signed by the customer; every eighth is a budget report."""
    k, number = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    person = F.concat(F.lit('<org:Henkilo met1:muuTunnus="'), F.col("o_custkey").cast("string"), F.lit('">'))
    body = F.concat(
        F.lit("<asi:IdentifiointiOsa><asi:Vireilletulo><met1:EduskuntaTunnus>HE "), number,
        F.lit("/2024 vp</met1:EduskuntaTunnus></asi:Vireilletulo>"),
        _if(k % 2 == 0, F.lit("<met:Toimija met1:rooliKoodi='X' x=\"y\"><met1:YhteisoTeksti>Muu</met1:YhteisoTeksti></met:Toimija>")),
        F.lit('<met:Toimija met1:rooliKoodi="Laatija"><met1:YhteisoTeksti>Hallintovaliokunta</met1:YhteisoTeksti></met:Toimija>'
              "</asi:IdentifiointiOsa><vsk:AsiaKuvaus><sis:KappaleKooste>Kuvaus</sis:KappaleKooste></vsk:AsiaKuvaus>"
              "<vsk:PaatosOsa><sis:KappaleKooste>Päätös "), number,
        F.lit("</sis:KappaleKooste></vsk:PaatosOsa><vsk:OsallistujaOsa>"), person, F.lit("</org:Henkilo>"), person,
        F.lit('</org:Henkilo><org:Henkilo met1:muuTunnus="x1"></org:Henkilo></vsk:OsallistujaOsa><vas:JasenMielipideOsa>'
              "<asi:PerusteluOsa><sis:KappaleKooste>Vastaan "), number,
        F.lit("</sis:KappaleKooste></asi:PerusteluOsa><asi:Allekirjoittaja>"), person,
        F.lit("<org1:EtuNimi>A</org1:EtuNimi><org1:SukuNimi>B</org1:SukuNimi></org:Henkilo></asi:Allekirjoittaja>"
              "</vas:JasenMielipideOsa>"),
    )
    tag = F.when(k % 8 == 0, "TalousarvioMietinto").otherwise("Mietinto")
    return widen(b.table(s, d, "orders"), TASKS).select(
        F.concat(
            F.lit('<ns11:Siirto><jme:JulkaisuMetatieto met1:laadintaPvm="2024-02-03" met1:eduskuntaTunnus="HaVM '), number,
            F.lit('/2024 vp"/><vml:'), tag, F.lit(">"), body, F.lit("</vml:"), tag, F.lit("></ns11:Siirto>"),
        ).alias("XmlData")
    )


def _report(name):
    def run(s, d):
        return doc.build_committee_reports(report_xml(s, d), b.supplier_persons(s, d))[name]

    return run


def absence_xml(s, d):
    k = F.col("o_orderkey")
    return b.rollcalls(s, d).withColumn("o_orderkey", F.col("person_id")).select(
        F.col("id").alias("Eduskuntatunnus"),
        F.concat(
            F.lit('<r><met:Toimija><org:Henkilo met1:muuTunnus="'), k.cast("string"),
            F.lit('"><org1:LisatietoTeksti>'), F.when(k % 2 == 0, "(e)").otherwise("(s)"),
            F.lit("</org1:LisatietoTeksti></org:Henkilo></met:Toimija></r>"),
        ).alias("XmlData"),
    )


def statute_xml(s, d):
    """A statute per order with a table in its moment and, in every third, another between its moments."""
    number = F.col("o_orderkey").cast("string")

    def row(*cells):
        return _el("tau:row", *[_el("tau:entry", _el("sis:KappaleKooste", c)) for c in cells])

    def grid(*cells):
        return _el("tau:table", _el("tau:tgroup", "<tau:colspec/><tau:colspec/>", _el("tau:tbody", row("Vuosi", "Määrä"), row(*cells))))

    return widen(b.table(s, d, "orders"), TASKS).select(F.col("o_orderkey").alias("id"), _el(
        "saa:SaadosOsa", _el("saa:Saados", _el("saa:SaadosNimekeKooste", "Laki ", number), _el(
            "saa:Pykala", _el("saa:PykalaTunnusKooste", "1 §"),
            _el("saa:MomenttiKooste", "Luku on.", grid(F.year("o_orderdate").cast("string"), F.col("o_orderpriority"))),
            _if(F.col("o_orderkey") % 3 == 0, grid("x | y", number)),
            _el("saa:KohdatMomentti", _el("saa:MomenttiJohdantoKooste", "Ovat:"), _el("saa:MomenttiKohtaKooste", "1) yksi")),
        ))).alias("xml"))


_NL = "chr(10)"
STATUTE = f"""SELECT o_orderkey AS id, '# Laki ' || o_orderkey || repeat({_NL}, 3) || '**1 §**' || repeat({_NL}, 2) || 'Luku on.' || repeat({_NL}, 2)
  || '| Vuosi | Määrä |' || {_NL} || '| --- | --- |' || {_NL} || '| ' || year(o_orderdate) || ' | ' || o_orderpriority || ' |'
  || CASE WHEN o_orderkey % 3 = 0 THEN repeat({_NL}, 2) || '| Vuosi | Määrä |' || {_NL} || '| --- | --- |' || {_NL} || '| x \\| y | ' || o_orderkey || ' |' ELSE '' END
  || repeat({_NL}, 2) || 'Ovat:' || repeat({_NL}, 2) || '- 1) yksi' AS law_changes FROM orders"""

QUERIES = {
    "xml_statute_tables": (lambda s, d: statute_xml(s, d).select("id", law_changes("xml").alias("law_changes")), STATUTE),
    "xml_persons": (
        lambda s, d: people.build_persons(member_xml(s, d)).drop("photo"),
        """SELECT o_orderkey::INT AS id, 'F' || o_orderkey AS first_name, o_orderpriority AS last_name,
        'F' || o_orderkey || ' ' || o_orderpriority AS full_name, '09 ' || o_orderkey AS phone_number,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '@x.fi' END AS email, o_orderstatus AS occupation,
        year(o_orderdate)::INT AS year_of_birth, 'Place' AS place_of_birth, 'Home ' || o_orderpriority AS place_of_residence
        FROM orders""",
    ),
    "xml_ministers": (
        lambda s, d: people.build_ministers(member_xml(s, d))[0].select(
            "person_id", "minister_position", "cabinet_id", _iso("start_date").alias("start_date"),
            _iso("end_date").alias("end_date")),
        f"""SELECT o_orderkey::INT AS person_id, 'Minister ' || o_orderpriority AS minister_position,
        'Cabinet' AS cabinet_id, '1995-01-01' AS start_date, {DAY} AS end_date FROM orders WHERE o_orderkey % 5 = 0""",
    ),
    "xml_minister_positions": (
        lambda s, d: people.build_ministers(member_xml(s, d))[1],
        "SELECT DISTINCT 'Minister ' || o_orderpriority AS title FROM orders WHERE o_orderkey % 5 = 0",
    ),
    "xml_interests": (
        lambda s, d: people.build_interests(member_xml(s, d)).drop("id"),
        """SELECT o_orderkey::INT AS person_id, 'Lahjat' AS category, 'x ' || o_orderkey AS interest
        FROM orders WHERE o_orderkey % 2 = 1""",
    ),
    "xml_parliamentary_groups": (
        lambda s, d: people.build_parliamentary_groups(member_xml(s, d)),
        """SELECT lower(o_orderpriority) AS id, min(o_orderpriority) AS name FROM orders GROUP BY 1
        UNION ALL SELECT 'vihr', 'Vihreä eduskuntaryhmä'""",
    ),
    "xml_group_memberships": (
        lambda s, d: people.build_group_memberships(member_xml(s, d)).select(
            "pg_id", "person_id", _iso("start_date").alias("start_date"), _iso("end_date").alias("end_date")),
        f"""SELECT 'vihr' AS pg_id, o_orderkey::INT AS person_id, {DAY} AS start_date, NULL AS end_date
        FROM orders WHERE o_orderkey % 4 = 0
        UNION ALL SELECT lower(o_orderpriority), o_orderkey::INT, {DAY}, '2005-02-01' FROM orders
        UNION ALL SELECT lower(o_orderpriority), o_orderkey::INT, '2006-12-28', NULL FROM orders""",
    ),
    "xml_assemblies": (
        lambda s, d: people.build_assemblies(s, member_xml(s, d)),
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{c}', '{n}')" for c, n in schemas.ASSEMBLIES)
        + """) t(code, name) UNION ALL SELECT DISTINCT NULL, 'Committee ' || o_orderpriority FROM orders
        WHERE o_orderkey % 2 = 0 AND (o_orderkey % 3 = 1 OR o_orderkey % 3 = 0 AND o_orderdate >= DATE '2000-01-01')""",
    ),
    "xml_committee_memberships": (
        lambda s, d: people.build_committee_memberships(member_xml(s, d)).select(
            "person_id", "committee_name", _iso("start_date").alias("start_date"), _iso("end_date").alias("end_date"),
            "role"),
        f"""WITH seated AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0)
        SELECT o_orderkey::INT AS person_id, 'Committee ' || o_orderpriority AS committee_name, '1996-01-01' AS start_date,
          '1998-12-31' AS end_date, 'associate' AS role FROM seated WHERE o_orderkey % 2 = 0
        UNION ALL SELECT o_orderkey::INT, 'Committee ' || o_orderpriority, {DAY}, NULL, 'chair' FROM seated WHERE o_orderkey % 2 = 0
        UNION ALL SELECT o_orderkey::INT, 'Suuri valiokunta', {DAY}, '1999-12-31', 'member' FROM seated""",
    ),
    "xml_records": (
        lambda s, d: minutes.build_records(minutes_xml(s, d)).select(
            "assembly_code", "number", "year", _iso("meeting_date").alias("meeting_date"),
            _iso("creation_date").alias("creation_date"), "rollcall_id"),
        """SELECT DISTINCT CASE WHEN conv_id % 5 = 0 THEN 'HaV' ELSE 'EK' END AS assembly_code, conv_id::INT AS number,
        (2024 + turn // 1000)::INT AS year, CASE WHEN conv_id % 3 <> 0 THEN '2024-01-15' ELSE '2024-01-16' END AS meeting_date,
        '2024-01-16' AS creation_date, CASE WHEN conv_id % 5 <> 0 THEN 'EDK-' || conv_id END AS rollcall_id
        FROM conversations""",
    ),
    "xml_agenda_items": (
        lambda s, d: minutes.build_agenda_items(minutes_xml(s, d)),
        """SELECT DISTINCT 'he ' || conv_id || '/' || (2023 + turn // 1000) || ' vp' AS parliament_id,
        CASE WHEN conv_id % 5 = 0 THEN 'HaV' ELSE 'EK' END AS record_assembly_code, conv_id::INT AS record_number,
        (2024 + turn // 1000)::INT AS record_year, 'Asia - ' || conv_id AS title FROM conversations""",
    ),
    "xml_speeches": (
        lambda s, d: minutes.build_speeches(minutes_xml(s, d)).select(
            "id", "person_id", "record_number", "agenda_item_parliament_id", "speech", "speech_type", "response_to",
            F.unix_seconds("start_time").alias("epoch")),
        with_(THREADED)
        + f"""SELECT turn_id AS id, person_id::INT AS person_id, item_id::INT AS record_number,
        'he ' || item_id || '/' || (2023 + pos // 1000) || ' vp' AS agenda_item_parliament_id,
        array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: {STRIP}), lambda x: x <> '')
          || CASE WHEN pos % 2 = 0 THEN ['**Puhemies**: Kiitos!'] ELSE [] END, chr(10) || chr(10)) AS speech,
        'T' AS speech_type, response_to,
        CAST(epoch(TIMESTAMP '2024-01-15 08:00:00') AS BIGINT) + (pos % 60) * 60 AS epoch FROM threaded""",
    ),
    "xml_absences": (
        lambda s, d: build_absences(
            minutes.extract_absentees(absence_xml(s, d)), b.records(s, d), b.rollcall_exclusions(s, d))[0]
        .groupBy("record_assembly_code", F.col("work_related").cast("int").alias("work_related"))
        .agg(F.count(F.lit(1)).alias("n")),
        with_("""
        numbered AS (
          SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'PTK' ELSE 'EDK-' || year(o_orderdate) || '-AK-' || o_orderkey END AS rc
          FROM orders)""")
        + """SELECT 'EK' AS record_assembly_code, (o_custkey % 2 = 0)::INT AS work_related, count(*) AS n FROM numbered
        WHERE rc NOT IN ('EDK-1997-AK-1', 'EDK-1998-AK-3')
          AND (rc = 'PTK' OR (o_orderstatus = 'F' AND o_orderkey % 4 <> 0)) GROUP BY ALL""",
    ),
    "xml_law_proposals": (
        lambda s, d: doc.build_law_proposals(proposal_xml(s, d), handling_xml(s, d), b.supplier_persons(s, d))[0]
        .withColumn("date", _iso("date")),
        with_(DOCS) + f"""SELECT 'la ' || tail AS id, 'mp_law' AS ptype, {DAY} AS date, 'Aloite ' || o_orderkey AS title,
        'Tiivis ' || o_orderpriority AS summary,
        '## Yleistä' || chr(10) || chr(10) || 'Summa **' || o_orderstatus || '** on' AS reasoning,
        {LAW_TEXT} AS law_changes,
        CASE o_orderstatus WHEN 'F' THEN 'passed_urgent' WHEN 'P' THEN 'resting' ELSE 'open' END AS status
        FROM docs WHERE o_orderkey % 9 <> 0""",
    ),
    "xml_law_proposal_signatures": (
        lambda s, d: doc.build_law_proposals(proposal_xml(s, d), handling_xml(s, d), b.supplier_persons(s, d))[1]
        .withColumn("first", F.col("first").cast("int")),
        SIGNED.format(key="proposal_id"),
    ),
    "xml_petitions": (
        lambda s, d: doc.build_petitions(
            proposal_xml(s, d).withColumn("XmlData", F.replace("XmlData", F.lit('Tunnus="LA'), F.lit('Tunnus="TPA'))),
            b.table(s, d, "orders").where("o_orderstatus = 'F'").select(
                F.concat(F.lit("tpa "), F.col("o_orderkey").cast("string"), F.lit("/2024 vp")).alias("parliament_id")),
            b.supplier_persons(s, d))[0].withColumn("date", _iso("date")),
        with_(DOCS) + f"""SELECT 'tpa ' || tail AS id, 'mp_petition' AS ptype, {DAY} AS date, 'Aloite ' || o_orderkey AS title, 'Tiivis ' || o_orderpriority AS summary,
        '## Yleistä' || chr(10) || chr(10) || 'Summa **' || o_orderstatus || '** on' AS reasoning, {LAW_TEXT} AS law_changes,
        CASE WHEN o_orderstatus = 'F' AND block = 0 THEN 'handled' ELSE 'open' END AS status FROM docs WHERE o_orderkey % 9 <> 0""",
    ),
    "xml_government_proposals": (
        lambda s, d: doc.build_government_proposals(
            proposal_xml(s, d, "he:HallituksenEsitys").withColumn("XmlData", F.when(
                F.col("seq") % 4 == 0, F.replace("XmlData", F.lit('Tunnus="LA'), F.lit('Tunnus="RP'))
            ).otherwise(F.col("XmlData"))),
            handling_xml(s, d), b.supplier_persons(s, d))[0].withColumn("date", _iso("date")),
        with_(DOCS) + f"""SELECT 'la ' || tail AS id, 'government' AS ptype, {DAY} AS date, 'Aloite ' || o_orderkey AS title, 'Tiivis ' || o_orderpriority AS summary,
        '## Yleistä' || chr(10) || chr(10) || 'Summa **' || o_orderstatus || '** on' AS reasoning, {LAW_TEXT} AS law_changes,
        CASE o_orderstatus WHEN 'F' THEN 'passed_urgent' WHEN 'P' THEN 'resting' ELSE 'open' END AS status
        FROM docs WHERE o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0""",
    ),
    "xml_interpellations": (
        lambda s, d: doc.build_interpellations(
            proposal_xml(s, d, "kys:Kysymys"), handling_xml(s, d), b.supplier_persons(s, d))[0]
        .withColumn("date", _iso("date")),
        with_(DOCS) + f"""SELECT 'la ' || tail AS id, {DAY} AS date, 'Aloite ' || o_orderkey AS title,
        '## Yleistä' || chr(10) || chr(10) || 'Summa **' || o_orderstatus || '** on' AS reasoning,
        '- ponsi ' || o_orderkey AS motion,
        CASE o_orderstatus WHEN 'F' THEN 'passed_urgent' WHEN 'P' THEN 'resting' ELSE 'open' END AS status
        FROM docs WHERE o_orderkey % 9 <> 0""",
    ),
    "xml_interpellation_signatures": (
        lambda s, d: doc.build_interpellations(
            proposal_xml(s, d, "kys:Kysymys"), handling_xml(s, d), b.supplier_persons(s, d))[1]
        .withColumn("first", F.col("first").cast("int")),
        SIGNED.format(key="interpellation_id"),
    ),
    "xml_without_twin": (
        lambda s, d: doc.without_twin(proposal_xml(s, d), "mp_law"),
        with_(DOCS) + "SELECT 'la ' || tail AS id FROM docs WHERE o_orderkey % 9 = 0",
    ),
    "xml_unresolved_signers": (
        lambda s, d: resolve_signers(
            doc.extract_signers(doc.with_body(proposal_xml(s, d), "mp_law")), b.supplier_persons(s, d)
        )[1].groupBy("first_name").agg(F.count(F.lit(1)).alias("n")),
        "SELECT 'nobody' AS first_name, count(*) AS n FROM lineitem WHERE l_linenumber = 6 AND l_orderkey % 9 <> 0",
    ),
    "xml_committee_reports": (
        lambda s, d: _report("committee_reports")(s, d).withColumn("date", _iso("date")),
        """SELECT 'havm ' || o_orderkey || '/2024 vp' AS id, 'he ' || o_orderkey || '/2024 vp' AS proposal_id,
        '2024-02-03' AS date, 'Hallintovaliokunta' AS committee_name, 'Kuvaus' AS proposal_summary,
        'Päätös ' || o_orderkey AS opinion, 'Vastaan ' || o_orderkey AS reasoning, NULL AS law_changes
        FROM orders WHERE o_orderkey % 8 <> 0""",
    ),
    "xml_report_participants": (
        _report("committee_report_signatures"),
        """SELECT 'havm ' || o_orderkey || '/2024 vp' AS committee_report_id, o_custkey AS person_id
        FROM orders WHERE o_orderkey % 8 <> 0""",
    ),
    "xml_objections": (
        lambda s, d: _report("objections")(s, d).join(
            _report("objection_signatures")(s, d).withColumnRenamed("objection_id", "id"), "id").drop("id"),
        """SELECT 'havm ' || o_orderkey || '/2024 vp' AS committee_report_id, 'Vastaan ' || o_orderkey AS reasoning,
        NULL AS motion, o_custkey AS person_id FROM orders WHERE o_orderkey % 8 <> 0""",
    ),
    "xml_paths": (
        lambda s, d: b.raw_documents(s, d).select(
            "doc_id",
            F.get(xml_path(F.regexp_replace("xml", r"[^\x{9}\x{A}\x{D}\x{20}-\x{FFFF}]", ""), '//*[local-name()="Tyyppi"]/text()'), 0)
            .alias("kind"),
        ),
        "SELECT doc_id, 'VASKI_JULKVP_' || source || '_' || lang AS kind FROM documents",
    ),
}
