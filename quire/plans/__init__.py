"""Jobs: command-line programs that read, compose operators and write."""
