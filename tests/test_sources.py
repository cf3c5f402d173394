"""Index, inflation and register sources on small files."""

import json
import zipfile

import pytest

from casario.sources import indices, register
from casario.sources.workbook import Workbook


def sheet(rows):
    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, tuple):
            return f'<c r="{ref}" s="1"><v>{v[0]}</v></c>'
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    def name(i):
        return chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26)

    body = "".join(f'<row r="{n}">' + "".join(cell(f"{name(i)}{n}", v) for i, v in sorted(r.items())) + "</row>" for n, r in rows.items())
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


@pytest.fixture
def workbook(tmp_path):
    head = {2: {2: "Venda", 20: "Locação", 40: "Rentabilidade"}, 3: {}, 4: {12: "Var. em 12 meses", 17: "Preço médio", 32: "Var. em 12 meses", 37: "Preço médio", 42: "Aluguel mensalizada"}}
    good = head | {5: {1: (46235,), 17: 10500.5, 12: 0.05, 37: 50, 42: "-"}, 6: {1: (46266,), 17: 10600, 42: 0.006}, 7: {1: "fonte", 17: 1}}
    bad = {2: {2: "Locação", 20: "Venda"}, 4: head[4], 5: {1: (46235,), 17: 1}}
    path, ns, rel = tmp_path / "serie.xlsx", "http://schemas.openxmlformats.org", "officeDocument/2006/relationships"
    names = {"Santos": good, "Índice": bad}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{ns}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, 3)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="mmm/yy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        for i, rows in enumerate(names.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet(rows))
    return str(path)


def test_workbook_to_one_row_a_month(spark, workbook, tmp_path):
    spark.dataSource.register(Workbook)
    grid = spark.read.format("workbook").load(workbook)
    assert {r.cidade: r.motivo is None for r in indices.layout(grid).collect()} == {"Santos": True, "Índice": False}
    long = indices.sheet_series(grid)
    assert sorted(map(tuple, long.collect())) == [("Santos", "2026-08", "locacao_m2", 50.0), ("Santos", "2026-08", "venda_m2", 10500.5), ("Santos", "2026-08", "venda_var12", 0.05), ("Santos", "2026-09", "venda_m2", 10600.0), ("Santos", "2026-09", "yield_mensal", 0.006)]
    by = {r.mes_referencia: r for r in indices.monthly_index(long).collect()}
    assert by["2026-08"].yield_mensal is None and by["2026-08"].yield_p10 is None and by["2026-09"].venda_var12 is None
    assert by["2026-09"].yield_p90 == pytest.approx(0.006 * 0.882 / 0.625)
    for day in ("2026-08-30", "2026-09-30"):
        indices.write_capture(long if day > "2026-09" else long.limit(1), str(tmp_path / "raw"), day)
    assert indices.latest_capture(spark, str(tmp_path / "raw"), 2).count() == 5
    with pytest.raises(LookupError):
        indices.latest_capture(spark, str(tmp_path / "none"), 2)
    with pytest.raises(indices.UnexpectedLayout):
        indices.sheet_series(grid.where("cidade <> 'Santos'"))


def test_inflation_from_api_answers(spark, tmp_path):
    head = {"D2C": "Variável (Código)", "D3C": "Mês (Código)", "V": "Valor"}
    rows = [{"D2C": "63", "D3C": "202608", "V": "0.31"}, {"D2C": "2265", "D3C": "202608", "V": "..."}, {"D2C": "1", "D3C": "202608", "V": "7"}, {"D2C": "69", "D3C": "", "V": "7"}]
    (tmp_path / "a.json").write_text(json.dumps([head, *rows]))
    series = indices.api_series(indices.read_api(spark, str(tmp_path / "a.json")))
    assert sorted(map(tuple, series.collect()), key=str) == [("Brasil", "2026-08", "ipca_12m", None), ("Brasil", "2026-08", "ipca_mensal", 0.31)]
    (r,) = indices.monthly_inflation(series).collect()
    assert (r.ipca_mensal, r.ipca_12m, r.ipca_indice) == (0.31, None, None)
    (tmp_path / "b.json").write_text(json.dumps([head]))
    with pytest.raises(indices.UnexpectedLayout):
        indices.read_api(spark, str(tmp_path / "b.json"))


def test_register_from_zip_to_lookups(spark, tmp_path):
    text = "COD_MUNICIPIO;CEP;NOM_TIPO_SEGLOGR;NOM_SEGLOGR;LATITUDE;LONGITUDE;OUTRA\n" + "".join(f"3548500;{c};AV;ANA COSTA É;{lat};-46.3;x\n" for c, lat in (("11060-001", "-23.9"), ("11060-001", "-23.7"), ("11060-002", "ruim"), ("1106", "-23.9")))
    with zipfile.ZipFile(tmp_path / "3548500_SANTOS.zip", "w") as z:
        z.writestr("leia.txt", "x")
        z.writestr("dados.CSV", text.encode("latin-1"))
    own = register.projected(register.zipped_lines(spark, str(tmp_path / "*.zip")))
    assert own.count() == 4 and own.where("dsc_localidade IS NULL AND nom_seglogr = 'ANA COSTA É'").count() == 4
    register.write_register(own, str(tmp_path / "raw"))
    read = register.read_register(spark, str(tmp_path / "raw"))
    assert {(r.municipio, r.ano_censo, r.cod_municipio) for r in read.collect()} == {("Santos", "2022", "3548500")}
    assert [tuple(r) for r in register.street_lookup(read).select("municipio", "chave", "cep", "n_enderecos", "n_ceps").collect()] == [("Santos", "avenida ana costa", "11060001", 3, 2)]
    assert [tuple(r) for r in register.point_lookup(read).collect()] == [("Santos", "11060001", pytest.approx(-23.8), -46.3, 2)]
    with pytest.raises(register.UnexpectedLayout):
        register.projected(own.drop("cep"))
