"""What serves other programs: tools over standard input, badges, and the HTML report."""
