"""Hand-made workbook files for the reader's tests."""

import zipfile

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_workbook(path, sheets, active=0, shared=(), formats=(), date_1904=False):
    """``sheets``: XML of the rows of each sheet; ``formats``: number format ids of the cell styles."""
    with zipfile.ZipFile(path, "w") as archive:
        base = '<workbookPr date1904="1"/>' if date_1904 else ""
        names = "".join(f'<sheet name="s{i}" sheetId="{i + 1}" r:id="r{i}"/>' for i in range(len(sheets)))
        archive.writestr(
            "xl/workbook.xml",
            f'<workbook {MAIN} xmlns:r="{OFFICE}">{base}<bookViews><workbookView activeTab="{active}"/></bookViews>'
            f"<sheets>{names}</sheets></workbook>",
        )
        links = "".join(
            f'<Relationship Id="r{i}" Type="{OFFICE}/worksheet" Target="/xl/worksheets/sheet{i}.xml"/>'
            for i in range(len(sheets))
        )
        archive.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
        )
        for i, rows in enumerate(sheets):
            archive.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            items = "".join(f"<si>{item}</si>" for item in shared)
            archive.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{items}</sst>")
        if formats:
            styles = "".join(f'<xf numFmtId="{fmt}"/>' for fmt in formats)
            custom = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot; d&quot;"/></numFmts>'
            archive.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{custom}<cellXfs>{styles}</cellXfs></styleSheet>")
