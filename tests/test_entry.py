import subprocess
import sys


def test_core_imports_without_llm():
    code = "import sys; sys.modules['quillspan.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    code = code.replace("sys.modules['quillspan.llm'] = None; ", "import importlib.abc, importlib.machinery; F = type('F', (importlib.abc.MetaPathFinder,), {'find_spec': lambda s, n, p=None, t=None: (_ for _ in ()).throw(ModuleNotFoundError(name=n)) if n.startswith('quillspan.llm') else None}); sys.meta_path.insert(0, F()); ")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
