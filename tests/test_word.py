"""Text boxes, links made of fields, and marks of runs in Word files."""

from quirespark.sources import docx

from .test_conversion import markdown, p, word

BOX = '<w:pict><v:shape><v:textbox><w:txbxContent>%s</w:txbxContent></v:textbox></v:shape></w:pict>'


def r(inside, properties=""):
    return f"<w:r><w:rPr>{properties}</w:rPr>{inside}</w:r>"


def t(text):
    return f'<w:t xml:space="preserve">{text}</w:t>'


def field(code, *shown):
    return r('<w:fldChar w:fldCharType="begin"/>') + r(f"<w:instrText>{code}</w:instrText>") + r('<w:fldChar w:fldCharType="separate"/>') + "".join(shown) + r('<w:fldChar w:fldCharType="end"/>')


def test_text_boxes():
    box = BOX % (p("in the box") + p("and more"))
    assert markdown(word(f"<w:p>{r(t('before') + box + t(' after'))}</w:p>{p('next')}")) == "before after\n\nin the box\n\nand more\n\nnext"
    both = f"<mc:AlternateContent><mc:Choice>%s</mc:Choice><mc:Fallback>{BOX % p('old')}</mc:Fallback></mc:AlternateContent>"
    choice = f"<w:drawing><w:txbxContent>{p('new')}</w:txbxContent></w:drawing>"
    assert markdown(word(f"<w:p>{r(both % choice)}</w:p>")) == "new"  # one branch of two
    assert markdown(word(f"<w:p>{r(both % '')}</w:p>")) == "old"
    nested = BOX % (p("outer") + f"<w:p>{r(BOX % p('inner'))}</w:p>")
    assert markdown(word(f"<w:p>{r(nested)}</w:p>")) == "outer\n\ninner"


def test_links_of_fields():
    body = f"<w:p>{r(t('see '))}{field(' HYPERLINK &quot;http://x/y&quot; ', r(t('the ')), r(t('page'), '<w:b/>'))}{r(t(' now'))}</w:p>"
    assert markdown(word(body)) == "see [the **page**](http://x/y) now"
    assert markdown(word(f"<w:p>{field(' HYPERLINK \\l &quot;mark&quot; ', r(t('there')))}</w:p>")) == "[there](#mark)"
    assert markdown(word(f"<w:p>{field(' PAGEREF x ', r(t('12')))}{r(t(' pages'))}</w:p>")) == "12 pages"
    inner = field(" HYPERLINK &quot;u&quot; ", r(t("a")), field(" PAGE ", r(t("1"))), r(t("b")))
    assert markdown(word(f"<w:p>{inner}{r(t('c'))}</w:p>")) == "[a1b](u)c"
    simple = f"<w:p><w:fldSimple w:instr=' HYPERLINK &quot;v&quot; '>{r(t('s'))}</w:fldSimple><w:hyperlink w:anchor='k'>{r(t('h'))}</w:hyperlink></w:p>"
    assert markdown(word(simple)) == "[s](v)[h](#k)"
    assert docx.field_target('HYPERLINK "u" \\l "m" \\o "tip"') == "u#m" and docx.field_target("REF \\l x") is None


def test_marks_of_runs():
    body = f"<w:p>{r(t('a'), '<w:b/><w:i/>')}{r(t('b'), '<w:b w:val=%s0%s/>' % (chr(34), chr(34)))}{r(t('c'), '<w:strike/>')}{r(t('2'), '<w:vertAlign w:val=%ssuperscript%s/>' % (chr(34), chr(34)))}</w:p>"
    shown, _, _ = docx.to_html(word(body))
    assert shown == "<p><b><i>a</i></b>b<s>c</s><sup>2</sup></p>" and markdown(word(body)) == "***a***b~~c~~2"
