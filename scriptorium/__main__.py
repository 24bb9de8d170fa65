from scriptorium.cli import run

run()
