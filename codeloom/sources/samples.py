"""Code samples that give the text tables a code-like shape.

The input tables hold prose only. Each document is wrapped in one of these
samples (``@@`` takes the whole text, one comment line per text line), so the
blocks grow with the documents and keep their lengths, copies and repeats.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Sample:
    language: str          # declared language of the block
    label: str
    before: str            # text before the block
    after: str
    around: str            # bare text around the block
    prefix: str | None     # comment prefix of inserted lines; None: text becomes one quoted value
    code: str


SAMPLES = [
    Sample("python", "app.py", "", "", "", "# ",
           "import os\nimport flask\nfrom numpy.linalg import norm\n# @@\n\nclass Server(Base):\n"
           "    def run(self):\n        print('up')\n\nif __name__ == \"__main__\":\n    Server().run()\n"),
    Sample("text", "", "Step 2: Load the data\n", "", "", "# ",
           "from .loaders.csv import read\n# @@\ndef load(path):\n   return read(path)\n"),
    Sample("javascript", "", "", "", "", "// ",
           "const express = require('express');\nimport { a } from './lib/util';\nimport z from '@scope/pkg/deep';\n"
           "// @@\nfunction start() {\n  console.log('x' == 1);\n}\nmodule.exports = start;\n"),
    Sample("js", "server.js", "", "", "", "// ",
           "// @@\napp.get('/api/users', (req, res) => {\n  res.send(1);\n});\nexport default function handler() {}\n"),
    Sample("typescript", "", "", "Save it as models/user.ts please", "", "// ",
           "import { Injectable } from '@angular/core';\n// @@\nexport interface User { name: string }\n"
           "export class UserService extends BaseService {\n  find(id: number) { return id; }\n}\n"),
    Sample("json", "", "", "", "", None,
           '{\n  "name": "demo",\n  "version": "1.0.0",\n  "scripts": {"start": "node ."},\n'
           '  "dependencies": {},\n  "note": "@@"\n}'),
    Sample("text", "", "", "", "", None, '{"manifest_version": 3, "note": "@@"}'),
    Sample("json", "", "Here is the config", "", "", None, '{"compilerOptions": {"note": "@@"},}'),
    Sample("yaml", "", "", "", "", "# ", "# @@\nversion: '3'\nservices:\n  web:\n   image: nginx\n"),
    Sample("yml", "", "", "", "", "# ", "name: build\non: push\n# @@\njobs:\n\tbad: tab\n"),
    Sample("dockerfile", "", "", "", "", "# ",
           "FROM python:3\n# @@\nRUN pip install flask\nCOPY . /app\nCMD [\"python\", \"app.py\"]\n"),
    Sample("makefile", "", "", "", "", "# ", "all: build\n# @@\n.PHONY: all\nclean:\n\trm -f out\n"),
    Sample("sql", "", "", "", "", "-- ",
           "-- @@\nCREATE TABLE t (id INT);\nSELECT * FROM t WHERE id = 1;\nSELECT id\n"),
    Sample("bash", "", "Run this\n", "", "", "# ",
           "#!/bin/bash\n# @@\necho \"install\ncd /tmp\nexport A='1'\n"),
    Sample("css", "", "", "", "", " * ", "/* @@ */\n:root {\n  --main: #fff;\n}\n.btn { color: red !important; }\n"),
    Sample("html", "index.html", "", "", "", "",
           "<!DOCTYPE html>\n<html><head><title>index</title></head>\n<body><main><p>@@</p><br></main>\n<div></body></html>\n"),
    Sample("html", "", "", "", "see templates/page.html for it", "",
           "<html><head></head><body><form><p>@@</form></body></html>\n"),
    Sample("markdown", "", "", "", "", "",
           "# Overview\n@@\n##Bad heading\nsee http://example.org/x\n```\ncode\n"),
    Sample("java", "src/main/Main.java", "", "", "", "// ",
           "import java.util.List;\nimport org.springframework.boot.Run;\n// @@\n@Entity\npublic class Order extends Model {\n"
           "  private int id;\n  @Test\n  public static void main(String[] a) { System.out.println(1); }\n}\n"),
    Sample("go", "", "## 3. Entry point\n", "", "", "// ",
           "package main\n\nimport (\n\t\"fmt\"\n\t\"github.com/gin-gonic/gin\"\n)\n// @@\nfunc main() {\n\tfmt.Println(1)\n}\n"),
    Sample("rust", "", "Create a struct\nParser core", "", "", "// ",
           "use std::io;\n// @@\n#[derive(Debug)]\npub struct Parser { n: i32 }\nimpl Parser { fn test_it() {} }\n"),
    Sample("ruby", "lib\\tool.rb", "", "", "", "# ", "require 'json'\n# @@\nclass Tool\n  def go\n    puts 1\n  end\nend\n"),
    Sample("php", "./a/../web/index.php", "", "", "", "// ", "<?php\n// @@\nnamespace App;\nfunction hi() { echo $_GET['x']; }\n"),
    Sample("cpp", "", "", "", "new file src/engine.cpp", "// ",
           "#include <vector>\n// @@\nusing namespace std;\nint main() {\n  cout << 1;\n}\n"),
    Sample("text", "", "", "", "", "",
           "@@\nproject/\n├── src/\n│   ├── app.py\n│   └── utils/\n│       └── helper.py\n├── web/\n│   └── index.php\n└── README.md\n"),
    Sample("text", "", "", "", "", "# ", "node_modules/\n*.log\n.env\n# @@\ndist/\nbuild/\n"),
    Sample("text", "", "Note that all of this was said before by someone", "", "", "", "@@\n"),
    Sample("", "", "", "", "", "", "```python tools/run.py\n@@\n```\n"),
    Sample("scss", "", "", "", "", "// ", "$brand-main: red;\n// @@\n.box { font-size: 1px; }\n"),
    Sample("python", "", "", "", "", "# ",
           "# file: jobs/daily.py\nimport pandas as pd\n# @@\nclass Invoice(models.Model):\n    total = fields.Int()\n"
           "def test_total():\n  assert True\n"),
    Sample("vue", "", "", "", "", "",
           "<template><div>@@</div></template>\n<script>\nexport default const Card = useThing;\n</script>\n"),
]

# Hosts the sample pages live on; most are sites with rules of their own.
HOSTS = ["chatgpt.com", "claude.ai", "gemini.google.com", "app.outlier.ai", "chat.mistral.ai", "poe.com",
         "github.com", "stackoverflow.com", "blog.example.org", "docs.example.net"]
