"""Tables, folders of files, and parsers of HTML and Markdown."""
