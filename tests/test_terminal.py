from quarrylog.functions import terminal_rules as tr
from quarrylog.operators import terminal
from quarrylog.sources import logs as source


def session(spark, text):
    df = spark.createDataFrame([("s", text)], "source_id string, text string")
    return terminal.classify(source.lines(source.pasted(df)))


def run(spark, text):
    lines = session(spark, text)
    rows = terminal.ranked(terminal.issues(lines)).collect()
    return rows, terminal.totals(lines, terminal.line_roles(lines)).first()


def test_rules_are_in_order():
    assert len(tr.RULES) == 43
    assert tr.RULES[tr.TRACEBACK].error_type == "Traceback"


def test_ansi_and_unknown_command(spark):
    rows, total = run(spark, "$ foo\n\x1b[31mbash: foo: command not found\x1b[0m")
    assert (len(rows), rows[0].category, rows[0].error_type, rows[0].command, total.command_count) == (1, "Command Error", "UnknownCommand", "foo", 1)
    assert "\x1b" in rows[0].raw_lines[0] and rows[0].normalized_lines == ["bash: foo: command not found"]


def test_stack_of_a_script(spark):
    rows, total = run(spark, "ReferenceError: x is not defined\n    at run (/srv/app.js:42:19)\n    at main (/srv/app.js:50:3)\ndone")
    r = rows[0]
    assert (r.category, r.stack_count, total.stack_frame_count, r.file_path, r.file_line) == ("Runtime Error", 2, 2, "/srv/app.js", 42)
    assert (r.parsed_stack[0].function_name, r.parsed_stack[0].line_number, r.parsed_stack[0].column_number) == ("run", 42, 19)
    assert (total.total_lines, total.non_blank_lines) == (2, 4)


def test_traceback_takes_its_exception(spark):
    rows, _ = run(spark, 'Traceback (most recent call last):\n  File "app.py", line 3, in <module>\nValueError: bad\nnext')
    assert [(r.category, r.message, r.error_type, r.last_line, r.file_path, r.file_line) for r in rows] == [("Python", "ValueError: bad", "ValueError", 3, None, 3)]


def test_lone_frame_goes_to_the_newest_issue(spark):
    rows, total = run(spark, "npm ERR! code E1\nok\nfatal: not a git repository\nok\nnpm ERR! code E1\nok\n    at x (/a/b.js:1:2)")
    by = {r.error_type: r for r in rows}
    assert (by["E1"].occurrences, by["E1"].stack_count) == (2, 0)
    assert by["GitFatal: not a git repository"].stack_count == 1
    assert total.error_count == 3


def test_blank_lines_inside_blocks(spark):
    rows, _ = run(spark, "TypeError: a\n\n    at x (/a/b.js:1:2)")
    assert rows[0].last_line == 3
    rows, _ = run(spark, "TypeError: a\n\n\n    at x (/a/b.js:1:2)")
    assert (rows[0].last_line, rows[0].stack_count) == (1, 1)


def test_warning_and_clean_session(spark):
    rows, total = run(spark, "npm WARN deprecated x")
    assert (rows[0].error_type, rows[0].kind, rows[0].severity, total.warning_count) == ("DeprecationWarning" if "deprecat" in "npm warn" else "Warning", "warning", "Medium", 1)
    rows, total = run(spark, "$ ls\nfile\n$ pwd\n/home")
    assert (rows, total.command_count, total.error_count) == ([], 2, 0)


def test_paths(spark):
    lines = session(spark, "src/a/B.tsx:4:2 and /long/er/C.py\napp.py").orderBy("line_number").collect()
    assert [(r.file_path, r.file_line) for r in lines] == [("/a/B.tsx", 4), (None, None)]


def test_rules_are_a_parameter(spark):
    own = (tr.Rule("own", "Own", r"boom (\d+)", "Boom: {1}", "Low", "warning"),)
    lines = spark.createDataFrame([("s", "$ go\nboom 7\nnpm ERR! x\nboom 7")], "source_id string, text string")
    found = terminal.classify(source.lines(source.pasted(lines)), own)
    row = terminal.issues(found, own).first()
    assert (row.category, row.error_type, row.severity, row.kind, row.occurrences, row.command) == ("Own", "Boom: 7", "Low", "warning", 2, "go")
    assert terminal.totals(found, terminal.line_roles(found, own), own).first().warning_count == 2
    assert terminal.commands(found).first().command == "go"
